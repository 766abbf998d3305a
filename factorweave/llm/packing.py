"""Best-fit packing into sequences of several permitted lengths.

Best-fit-decreasing treats pieces of one size alike, and bins of one history alike.  So the
plan is made from the histogram of sizes, which has no more rows than the longest permitted
length, and holds ranges of ranks within a size with the bins they go to.  The pieces find
their rank by a distributed sort and are placed where they lie.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import ordered, sums_before


class Plan:
    """Where the k-th piece of each size goes.

    counts: number of pieces of each size; capacities: permitted lengths, ascending.  When
    no open bin has room, the capacity is opened whose cost (its length plus `overhead`) for
    each token that can be put in is least.  At last each bin shrinks to the smallest
    permitted length that holds its contents.
    """

    def __init__(self, counts: dict[int, int], capacities: list[int], overhead: float = 16.0):
        self.capacities, self.overhead = sorted(capacities), overhead
        self.bins = 0
        self.segments: list[tuple[int, int, int, int, int]] = []  # size, first rank, first bin, pieces a bin, offset
        self.open: dict[int, list[tuple[int, int, int]]] = {}  # room left: (capacity, first bin, bins)
        self.rooms: list[int] = []
        left = sum(s * c for s, c in counts.items())
        for size in sorted(counts, reverse=True):
            left -= size * counts[size]
            self._place(size, counts[size], left)
        full = sorted((first, n, cap - room) for room, groups in self.open.items() for cap, first, n in groups)
        self.first_bin = np.array([x[0] for x in full] or [0], np.int64)
        used = np.array([x[2] for x in full] or [0], np.int64)
        self.final = np.array(self.capacities)[np.searchsorted(self.capacities, used)]
        self.used = used
        seg = np.array(self.segments or [(0, 0, 0, 1, 0)], np.int64)
        order = np.lexsort((seg[:, 1], seg[:, 0]))
        self.seg = seg[order]
        self.key = self.seg[:, 0] * (1 << 40) + self.seg[:, 1]

    def _add(self, room: int, group: tuple[int, int, int]) -> None:
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append(group)

    def _choose(self, size: int, count: int, later: int) -> int:
        """The capacity of least cost a token; of equal ones the shortest."""

        def cost(c: int) -> float:
            own = min(count, c // size) * size
            return (self.overhead + c) / (own + min(c - own, later))

        return min((c for c in self.capacities if c >= size), key=cost)

    def _place(self, size: int, count: int, later: int) -> None:
        rank = 0
        while count:
            i = bisect_left(self.rooms, size)
            if i == len(self.rooms):
                cap = self._choose(size, count, later)
                n = max(1, count // (cap // size))
                self._add(cap, (cap, self.bins, n))
                self.bins += n
                continue
            room = self.rooms[i]
            groups = self.open[room]
            cap, first, n = groups.pop()
            if not groups:
                del self.open[room], self.rooms[i]
            each = min(room // size, count)
            k = min(n, count // each)
            self.segments.append((size, rank, first, each, cap - room))
            self._add(room - each * size, (cap, first, k))
            if n > k:
                self._add(room, (cap, first + k, n - k))
            rank, count = rank + k * each, count - k * each

    def where(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset in it, final length of the bin) of pieces by size and rank within it."""
        seg = self.seg[np.searchsorted(self.key, size * (1 << 40) + rank, "right") - 1]
        own = rank - seg[:, 1]
        bin_ = seg[:, 2] + own // seg[:, 3]
        offset = seg[:, 4] + own % seg[:, 3] * size
        return bin_, offset, self.final[np.searchsorted(self.first_bin, bin_, "right") - 1]


def pack(items: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192), id_col: str = "doc_id", length_col: str = "length", overhead: float = 16.0) -> DataFrame:
    """doc_id, piece, size, bin, bin_offset and capacity of each piece.

    Items longer than the longest capacity are cut into pieces of that length and a rest, so
    nothing is dropped.  Null lengths and lengths below 1 count as 1.  Null ids sort first;
    repeated rows each get a place.  Empty table: no rows.  Other columns are ignored.
    """
    most = max(capacities)
    length = F.greatest(F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(1)), F.lit(1))
    cut = items.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), length.alias("length"))
    cut = cut.select("doc_id", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / most).cast("int"))).alias("piece"))
    cut = cut.select("doc_id", "piece", F.least(F.lit(most), F.col("length") - F.col("piece").cast("long") * most).cast("int").alias("size"))
    placed = ordered(cut, ["size", "doc_id", "piece"], "sized-pieces")
    counts = {r["size"]: r["n"] for r in placed.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `most` rows
    plan = Plan(counts, list(capacities), overhead)
    smaller = np.zeros(most + 2, np.int64)
    for s, n in counts.items():
        smaller[s + 1] = n
    smaller = np.cumsum(smaller)
    ranked = placed.join(F.broadcast(sums_before(placed, {"n": "count(*)"})), "part").select("doc_id", "piece", "size", (F.col("at") + F.col("n_before")).alias("place"))

    def rows(batches):
        for b in batches:
            size = b.column(2).to_numpy().astype(np.int64)
            bin_, offset, cap = plan.where(size, b.column(3).to_numpy() - smaller[size])
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(bin_), pa.array(offset.astype(np.int32)), pa.array(cap.astype(np.int32))], names=["doc_id", "piece", "size", "bin", "bin_offset", "capacity"])

    return ranked.mapInArrow(rows, "doc_id long, piece int, size int, bin long, bin_offset int, capacity int")


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length): words between ASCII white space, plus 1 for the document's end."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).alias("length"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(word_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
