"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import delete, keep, saved


def _least(edges: DataFrame, own: bool, paths: list[str]) -> DataFrame:
    """(a, m): the least node among the neighbours b of a, and a itself if `own`.

    It is stored, so that a join with it deals both sides by a shuffle of their own: then
    adaptive execution can split the rows of a hub.
    """
    least = F.least(F.min("b"), F.first("a")) if own else F.min("b")
    return saved(edges.groupBy("a").agg(least.alias("m")), "least", paths)


def _stars(edges: DataFrame, paths: list[str]) -> DataFrame:
    """One large-star and one small-star round over edges (a, b) with a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, own=True, paths=paths)
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = saved(large.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "large-star", paths)
    small = large.join(_least(large, own=False, paths=paths), "a")
    return small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a long, b long); root is the least node reachable.

    Edges are written to the shared folder after each round, which cuts the lineage; the
    driver sees only a count and a checksum.  What a round has read is deleted when its
    result is written.  Hubs are dealt by partial aggregation and by joins that adaptive
    execution may split.
    """
    old: list[str] = []
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges", old)
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        new: list[str] = []
        now = saved(_stars(now, old), "edges", new)
        delete(now.sparkSession, old)
        old = new
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    keep(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
