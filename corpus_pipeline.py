"""A training corpus from documents: five stages, each stored before the next reads it.

toxicity -> near_duplicates -> decontamination -> pii -> packing.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import scratch, short_key
from factorweave.llm.decontamination import decontaminate
from factorweave.llm.packing import pack, word_lengths
from factorweave.llm.pii import QUERY_KEY, pseudonymize
from factorweave.llm.simhash import distinct_documents
from factorweave.llm.toxicity import toxicity


def _bundled(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns in one, so that no operator meets their names."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("none")).alias("rest"))


def _unbundled(out: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, with those in `new` replaced."""
    at = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{i}") for i, c in enumerate(docs.columns)} | new
    return out.select([at[c].alias(c) for c in docs.columns])


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer, trained on the labels, doesn't reject."""
    scored = toxicity(_bundled(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unbundled(scored.where("predicted = 0"), docs)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of 0.8 or more) the row of the least id."""
    return distinct_documents(docs)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold too much of the benchmark; rows are told apart by 64 bits of id and text."""
    keyed = _bundled(docs).withColumn("key", short_key())
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    drop = found.where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return _unbundled(keyed.join(drop, "key", "left_anti"), docs)


def mask_pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; n_chars follows the new text."""
    out, new = pseudonymize(_bundled(docs), QUERY_KEY), {}
    if "n_chars" in docs.columns:
        old = F.col(f"rest.c{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.size("pii_kinds") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return _unbundled(out, docs, **new)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of the permitted lengths."""
    return pack(word_lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("packing", pack_sequences),
]

#: SQL can't express the trained scorer, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
