"""Preference formatting: chosen and rejected conversations with one common prompt.

The longest common turn prefix of both is rendered once; the rest of each becomes a
completion with a mask of the spans, in characters, that a loss may count: the texts of
assistant turns and the mark that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _END = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str, name: str) -> DataFrame:
    turn = F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = df.select(F.col(f"`{pair_col}`").cast("long").alias("pair_id"), turn.alias("t")).where("pair_id is not null")
    return own.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit(_OPEN), t["role"], F.lit(_CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(_END))), "")


def _mask(turns: Column) -> Column:
    """[start, end) of what assistants say in the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + F.lit(len(_END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a pair: pair_id, n_common, prompt, and completion and mask of both sides.

    Turns are ordered by turn, role and text; equal rows stay.  Null roles and texts count
    as empty.  Rows without a pair id belong to no pair.  A side that is missing, or that is
    all prompt, has an empty completion and mask.  Other columns are ignored.  A pair is one
    row, so a pair of conversations has to fit into a row (of at most 2 GB in Spark, and a few
    times that in its task); other conversations are not gathered with it.
    """
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    names = (pair_col, turn_col, role_col, text_col)
    both = _turns(chosen, *names, "c").join(_turns(rejected, *names, "r"), "pair_id", "full_outer").select("pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    both = both.withColumn("k", F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("k") + 1, F.greatest(F.size(side) - F.col("k"), F.lit(0)))
    return both.select(
        "pair_id", F.col("k").cast("long").alias("n_common"), _render(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        _render(rest("c")).alias("chosen"), _mask(rest("c")).alias("chosen_mask"), _render(rest("r")).alias("rejected"), _mask(rest("r")).alias("rejected_mask"),
    )


def op6_preferences(spark, sf_dir: str) -> DataFrame:
    """Each conversation of an even id is chosen over that of the next id."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("pair_id", F.expr("shiftright(conv_id, 1)"))
    out = format_preferences(turns.where("conv_id & 1 = 0"), turns.where("conv_id & 1 = 1"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return out.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


QUERIES = {"op6_preferences": op6_preferences}
ORACLE_SQL = {
    "op6_preferences": r"""
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, coalesce(a.role = b.role AND a.text = b.text, false) AS same
      FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos),
k AS (SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT same) - 1, count(*)) AS n_common FROM j GROUP BY pair_id),
r AS (SELECT t.*, n_common, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS full_text FROM t JOIN k USING (pair_id)),
o AS (SELECT *, sum(length(full_text)) OVER (PARTITION BY pair_id, side ORDER BY pos) AS stop FROM r WHERE pos > n_common),
c AS (SELECT pair_id, side, string_agg(full_text, '' ORDER BY pos) AS body,
      string_agg((stop - length(full_text) + length(head))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos) FILTER (WHERE role = 'assistant') AS mask FROM o GROUP BY pair_id, side),
p AS (SELECT pair_id, string_agg(full_text, '' ORDER BY pos) AS prompt FROM r WHERE side = 0 AND pos <= n_common GROUP BY pair_id)
SELECT k.pair_id, n_common::BIGINT AS n_common, coalesce(prompt, '') AS prompt, coalesce(x.body, '') AS chosen, coalesce(x.mask, '') AS chosen_mask,
       coalesce(y.body, '') AS rejected, coalesce(y.mask, '') AS rejected_mask
FROM k LEFT JOIN p ON k.pair_id = p.pair_id LEFT JOIN c x ON k.pair_id = x.pair_id AND x.side = 0 LEFT JOIN c y ON k.pair_id = y.pair_id AND y.side = 1"""
}
