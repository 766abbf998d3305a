"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form a group that is never cut.  Groups are ordered by their smallest doc_id;
the smallest capacity for which a greedy walk needs no more than the wanted shards is found
by bisection over running sums, and the cuts are made there.  DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorweave.llm.common import ordered, saved, sums_before


def group_sums(rows: DataFrame) -> DataFrame:
    """Groups (first, key, bytes, members) with the bytes and rows of all groups before them."""
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("members"))
    groups = ordered(groups, ["first", "key"], "groups")
    before = sums_before(groups, {"bytes": "sum(bytes)", "members": "sum(members)"})
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return saved(
        groups.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_own") for c in ("bytes", "members")])
        .join(before, "part")
        .select("key", "first", "bytes", "members", *[(F.col(f"{c}_own") + F.col(f"{c}_before")).alias(f"{c}_before") for c in ("bytes", "members")]),
        "group-sums",
    )


def _walk(sums: DataFrame, capacities: list[int], shards: int, total: int, most: int) -> list[list[int]]:
    """For each capacity the bytes before each cut of a greedy walk: a job for each shard, over all capacities.

    The stored groups are in order of bytes_before.  The last group that fits begins less than
    two of the largest groups before the shard's bound, so a job reads no other row groups.
    """
    at = [[0] for _ in capacities]
    end = F.col("bytes_before") + F.col("bytes")
    for _ in range(shards):
        bounds = [c + a[-1] for c, a in zip(capacities, at, strict=True) if c + a[-1] < total]
        if not bounds:
            return [[*a, total] for a in at]
        near = sums.where((F.col("bytes_before") >= F.lit(min(bounds) - 2 * most).cast("long")) & (F.col("bytes_before") <= F.lit(max(bounds)).cast("long")))
        got = near.agg(*[F.max(F.when(end <= F.lit(c + a[-1]).cast("long"), end)).alias(f"c{i}") for i, (c, a) in enumerate(zip(capacities, at, strict=True))]).first()
        for c, a, x in zip(capacities, at, got, strict=True):
            a.append(total if c + a[-1] >= total else max(a[-1], x or 0))
    return at


def _ends(sums: DataFrame, windows: list[tuple[int, int]], most_ends: int) -> list[int] | None:
    """The ends of groups inside the windows, in order; None if there are more than `most_ends`."""
    end = F.col("bytes_before") + F.col("bytes")
    inside = F.lit(False)
    for a, b in windows:
        inside = inside | end.between(a, b)
    got = sums.where(inside).select(end.alias("end")).limit(most_ends + 1).toArrow()["end"].to_pylist()
    return sorted(got) if len(got) <= most_ends else None


def cuts(sums: DataFrame, shards: int, ways: int = 64, most_ends: int = 1 << 20) -> list[int]:
    """The bytes before each shard under the smallest capacity that is enough.

    A cut of a greedy walk never moves back as the capacity grows.  So once the capacity is known to
    lie between two, each cut lies between theirs, and only groups that end there matter.  Where
    these are at most `most_ends` (8 MB of numbers) the rest of the search needs no job; until
    then rounds over the stored sums bring the capacity closer, `ways` at a time.
    """
    total, most = sums.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return [0]
    low, high = max(most, -(-total // shards)), -(-total // shards) + most  # the second is always enough
    windows = [(0, total)]
    walks: dict[int, list[int]] = {}
    while low < high:
        ends = _ends(sums, windows, most_ends)
        if ends is not None:
            return _searched(ends, low, high, shards, total)
        tried = sorted({low + (high - low) * i // ways for i in range(ways)})
        walks |= zip(tried, _walk(sums, tried, shards, total, most), strict=True)
        k = next((i for i, c in enumerate(tried) if walks[c][-1] == total), len(tried))
        if k == 0:
            high = low
            break
        high, low = (tried[k] if k < len(tried) else high), tried[k - 1] + 1
        before, after = walks[tried[k - 1]], walks.get(high)
        windows = [(before[j], after[j] if after and j < len(after) else min(j * high, total)) for j in range(1, shards + 1) if j < len(before)]
    at = walks[high] if high in walks else _walk(sums, [high], shards, total, most)[0]
    return sorted(set(at[:-1]) - {total})


def _searched(ends: list[int], low: int, high: int, shards: int, total: int) -> list[int]:
    """The cuts under the smallest capacity from low to high, of which high is enough, given all ends that cuts can fall on."""

    def walk(capacity: int) -> list[int]:
        at = [0]
        while at[-1] < total and len(at) <= shards:
            k = bisect_right(ends, at[-1] + capacity) - 1
            at.append(total if at[-1] + capacity >= total else max(at[-1], ends[k] if k >= 0 else 0))
        return at

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if walk(middle)[-1] >= total else (middle + 1, high)
    return sorted(set(walk(high)) - {total})


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document; shard sizes are minimax.

    size: UTF-8 bytes of the text plus 1.  Null text counts as empty, and is in the group of
    empty texts.  slot: the document's place in its shard, from 0, by group and then doc_id.
    Rows of a null doc_id come before others of their group; repeated rows share a group.
    Empty table: no rows.  Fewer groups than shards: the last shards stay empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")
    )
    rows = saved(rows, "sized-rows")
    sums = group_sums(rows)
    starts = cuts(sums, shards)
    start = F.array(*[F.lit(x).cast("long") for x in starts])
    number = F.size(F.filter(start, lambda x: x <= F.col("bytes_before"))) - 1
    placed = rows.join(sums.select("key", "first", number.alias("shard")), "key")
    placed = ordered(placed, ["first", "key", "doc_id", "size"], "placed-rows")
    before = sums_before(placed, {"n": "count(*)"})
    first = sums.groupBy(number.alias("shard")).agg(F.min("members_before").alias("shard_first"))  # a row for each shard
    return (
        placed.join(F.broadcast(before), "part")
        .join(F.broadcast(first), "shard")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("n_before") - F.col("shard_first")).alias("slot"))
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_of_documents(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_sharding, which also gives a CRC."""
    return op10_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "slot")


QUERIES = {"op10_sharding": op10_sharding, "shards_of_documents": shards_of_documents}

#: Bisection for the smallest capacity at which a greedy walk over the groups' ends comes to the total in 8 steps.
_GREEDY = "list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, i: coalesce(list_max(list_filter(ends, lambda x: x <= a + {0})), a))"
ORACLE_SQL = {
    "shards_of_documents": f"""
WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS key FROM documents),
g AS (SELECT key, min(doc_id) AS first, sum(size)::BIGINT AS bytes FROM d GROUP BY key),
e AS (SELECT key, first, sum(bytes) OVER (ORDER BY first, key)::BIGINT AS stop, bytes FROM g),
l AS (SELECT list(stop ORDER BY stop) AS ends, max(stop) AS total, max(bytes) AS most FROM e),
s AS (SELECT most AS low, total AS high FROM l UNION ALL
      SELECT CASE WHEN {_GREEDY.format('mid')} = total THEN low ELSE mid + 1 END, CASE WHEN {_GREEDY.format('mid')} = total THEN mid ELSE high END
      FROM (SELECT low, high, (low + high) // 2 AS mid FROM s WHERE low < high), l),
c AS (SELECT min(high) AS capacity FROM s),
w AS (SELECT 0 AS shard, 0::BIGINT AS start UNION ALL
      SELECT shard + 1, list_max(list_filter(ends, lambda x: x <= start + capacity)) FROM w, l, c WHERE shard < 7 AND start + capacity < total),
p AS (SELECT key, first, max(shard) AS shard FROM e JOIN w ON w.start <= e.stop - e.bytes GROUP BY ALL)
SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY first, key, doc_id, size) - 1 AS slot FROM d JOIN p USING (key)"""
}
