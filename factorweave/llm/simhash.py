"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into few segments.  If two differ in at most 4 bits, one of 3 segments
differs in at most one bit, so both have the same value there once a certain bit is deleted:
64 variants with one wildcard each are the index keys.  Rows that are equal in a key are
compared in full.  For many fingerprints keys get longer: c of 3 + c segments together differ
in at most one bit as well.

The variants of a key whose wildcard lies in the same third of it share the bits of its
other two thirds.  One row is shuffled for them, dealt by those bits; the task that gets it
makes the variants and joins them.  A task reads its rows in order, some whole groups at a
time, and gives back a spanning forest of the links it finds rather than all pairs.

Word shingles at a Jaccard similarity of 0.8 need more: such a pair differs in some 15 % of
its bits.  So `similar_texts` takes several independent fingerprints, each with the same
segments, whose deletion variants give candidates, and verifies them by their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factorweave.llm.common import fresh, row_key, saved, small_batches, texts
from factorweave.llm.components import components
from factorweave.llm.words import SPACE_WORD, Words, mix, pieces, text_buffer, window_hashes

_SEED = 42
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 1 << 17  # of an index that a task looks at together, or one group if that has more


def fingerprint(words: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of lower-cased words joined by one space; 0 without words."""
    if not words:
        return 0
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(words)]
    h = [xxh64_intdigest(words[a:b], _SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [xxh64_intdigest(words, _SEED)]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    up = 2 * bits.sum(0, dtype=np.int64) > len(h)
    return int(np.packbits(up, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def rows(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_buffer(part.column(1))
                data = data.tobytes().lower()
                own = [fingerprint(b" ".join(data[a:b].split()), shingle) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.record_batch([part.column(0), pa.array(np.array(own, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, fp long")


# ---- keys


def segments(n: int) -> list[int]:
    """The masks of n segments of 64 bits."""
    cut = [64 * i // n for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:], strict=False)]


def keys(bits: int = 4, together: int = 1) -> list[int]:
    """Masks of which one, whatever `bits` bits differ, has at most one of them.

    Each takes `together` segments: of bits // 2 + 1, or for more than one of
    bits + together - 1.
    """
    parts = segments(bits // 2 + 1 if together == 1 else bits + together - 1)
    return [sum(own) for own in combinations(parts, together)]


class Routes:
    """For each key and third of it: the bits that a row is dealt by, and its wildcard variants."""

    def __init__(self, masks: list[int]):
        self.dealt, wild = [], []
        for mask in masks:
            bits = [b for b in range(64) if mask >> b & 1]
            for j in range(3):
                third = bits[len(bits) * j // 3 : len(bits) * (j + 1) // 3]
                self.dealt.append(mask & ~sum(1 << b for b in third))
                wild.append([mask & ~(1 << b) for b in third])
        width = max(map(len, wild))
        self.used = np.array([[i < len(own) for i in range(width)] for own in wild])
        self.wild = np.array([own + [0] * (width - len(own)) for own in wild], np.uint64)
        self.masks = np.array(self.dealt, np.uint64)

    def __len__(self) -> int:
        return len(self.dealt)

    def mask(self, route: Column) -> Column:
        signed = [m - (m >> 63 << 64) for m in self.dealt]
        return F.element_at(F.array(*[F.lit(m).cast("long") for m in signed]), route + 1)

    def variants(self, x: np.ndarray, route: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the variants of all rows; `route` is this class's, `of` tells apart what is indexed alike."""
        row, found = [], []
        for i in range(self.wild.shape[1]):
            own = np.flatnonzero(self.used[route, i])
            row.append(own)
            found.append(mix(x[own] & self.wild[route[own], i]) + (of[own].astype(np.uint64) * np.uint64(64) + np.uint64(i)) * _ODD)
        return np.concatenate(row), np.concatenate(found)


# ---- links among the rows of a task


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root, with the nodes of each pair (a, b) joined; the least node of each component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def linked(nodes: np.ndarray, row: np.ndarray, keys: np.ndarray, words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over the links among rows of equal key.

    nodes and words are those of the rows, row and keys those of their index entries; rows
    are linked if their words differ in `bits` bits or fewer in all.
    """
    names, node = np.unique(nodes, return_inverse=True)
    order = np.lexsort((node[row], keys))
    key, row = keys[order], row[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(head, len(key)))
    keep = np.repeat(size > 1, size)  # keys of one row link nothing
    row, size = row[keep], size[size > 1]
    head = np.cumsum(size) - size
    of, end = node[row], np.repeat(head + size, size)  # of each entry: its node, and the end of its group
    words = [w.view(np.uint64)[row] for w in words]
    root, active, step = np.arange(len(names)), np.arange(len(row)), 1
    while True:
        active = active[active + step < end[active]]
        if not len(active):
            break
        other = active + step
        apart = sum(np.bitwise_count(w[active] ^ w[other]).astype(np.int16) for w in words)
        ok = apart <= bits
        root = _roots(len(names), of[active[ok]], of[other[ok]], root)
        if step & (step - 1) == 0:  # a group that is connected can't change the components
            r = root[of]
            low, high = np.minimum.reduceat(r, head), np.maximum.reduceat(r, head)
            active = active[(low != high)[np.searchsorted(head, active, "right") - 1]]
        step += 1
    apart = np.flatnonzero(root != np.arange(len(names)))
    return names[apart], names[root[apart]]


def whole_groups(batches, group: Callable, most: int = _ROWS) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, cut between groups into runs of about `most` rows."""
    held: list[list[np.ndarray]] = []
    n = wait = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n < max(most, wait):
            continue
        now = [np.concatenate(c) for c in zip(*held, strict=True)]
        of = group(*now)
        turn = np.flatnonzero(of[1:] != of[:-1])
        if len(turn):
            yield [c[: turn[-1] + 1] for c in now]
            now = [c[turn[-1] + 1 :] for c in now]
        held, n = [now], len(now[0])
        wait = 2 * n  # one long group isn't looked through again for each batch
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def links(fps: DataFrame, bits: int = 4, together: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links.

    together: segments in a key; by default so many that about 32 unrelated fingerprints,
    at most, share a key.
    """
    if together is None:
        n, together = fps.count(), 1
        while n > 32 << min(m.bit_count() - 1 for m in keys(bits, together)) and bits + together < 16:
            together += 1
    routes = Routes(keys(bits, together))

    def rows(batches):
        def group(x, route):
            return (x.view(np.uint64) & routes.masks[route]) + route.astype(np.uint64) * _ODD

        for x, route in whole_groups(batches, group):
            row, key = routes.variants(x.view(np.uint64), route, route)
            a, b = linked(x, row, key, [x], bits)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    index = fps.select("fp", F.explode(F.array(*[F.lit(i).cast("short") for i in range(len(routes))])).alias("route"))
    dealt = [F.col("route"), F.col("fp").bitwiseAND(routes.mask(F.col("route")))]
    return index.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id of each document: fingerprints link at `bits` or fewer differing bits.

    component_id is the smallest doc_id reachable over links, the document's own included.
    Texts without words (null, empty, blank) have fingerprint 0 and are linked like any
    others.  Rows of a null doc_id are linked, too; they never give a component its id
    unless all its rows have none, in which case it is null.  Repeated rows each stay.
    """
    own = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = saved(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), bits))
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = saved(of.join(least, "root").select("fp", "component_id"), "components")
    return own.join(of, "fp").select("doc_id", "fp", "component_id")


# ---- shingle sets at a Jaccard similarity


def shingle_sets(column, length: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, first): the sorted distinct shingle hashes of each text, one text after another.

    Words are cut at white space and lower-cased; a text of fewer words is one shingle, one
    without words none.
    """
    words = Words(column, SPACE_WORD, lower=True)
    ids, counts = words.hashes(), words.counts
    fits = words.fits(length)
    h, doc = [window_hashes(ids, length)[fits]], [words.doc[fits]]
    for k in range(1, length):
        short = np.flatnonzero(counts == k)
        h.append(window_hashes(ids, k)[words.first[short]])
        doc.append(short)
    h, doc = np.concatenate(h), np.concatenate(doc)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))


def majority(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] rows of words: the bits that are set in more than half of them.

    Bits are counted in planes: three words of a plane become their sum, which stays, and
    their carry, which goes to the next plane, until a run has one word in each plane.
    """
    planes, doc = [], np.repeat(np.arange(len(counts)), counts)
    while len(words):
        c, carries = np.bincount(doc, minlength=len(counts)), []
        while c.max() > 1:
            start, k = np.cumsum(c) - c, c // 3
            two = np.flatnonzero(c == 2)
            at = np.repeat(start - 3 * (np.cumsum(k) - k), k) + 3 * np.arange(k.sum())
            x, y, z = words[at], words[at + 1], words[at + 2]
            half = x ^ y
            carries += [((x & y) | (half & z), doc[at]), (words[start[two]] & words[start[two] + 1], two)]
            rest = np.where(c > 2, c % 3, c * (c < 2))
            left = np.repeat(start + c - rest - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())
            words = np.concatenate([half ^ z, words[left], words[start[two]] ^ words[start[two] + 1]])
            doc = np.concatenate([doc[at], doc[left], two])
            order = np.argsort(doc, kind="stable")
            words, doc = words[order], doc[order]
            c = np.bincount(doc, minlength=len(counts))
        plane = np.zeros((len(counts), words.shape[1]), np.uint64)
        plane[doc] = words
        planes.append(plane)
        words = np.concatenate([w for w, _ in carries]) if carries else words[:0]
        doc = np.concatenate([d for _, d in carries]) if carries else doc[:0]
        order = np.argsort(doc, kind="stable")
        words, doc = words[order], doc[order]
    more = np.zeros((len(counts), words.shape[1]), np.uint64)
    equal = ~more
    for j in range(len(planes) - 1, -1, -1):  # count > counts // 2, bit by bit from the highest
        bound = np.where(counts // 2 >> j & 1, ~np.uint64(0), np.uint64(0))[:, None]
        more |= equal & planes[j] & ~bound
        equal &= ~(planes[j] ^ bound)
    return more


def set_fingerprints(shingles: np.ndarray, first: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, check, fps): two hashes of each set, and `number` independent SimHashes; an empty set's are 0."""
    counts = np.diff(first)
    some = np.flatnonzero(counts)
    node, check = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    if len(some):
        node[some] = mix(np.add.reduceat(mix(shingles ^ _ODD), first[some]) + counts[some].astype(np.uint64))
        check[some] = mix(np.add.reduceat(mix(~shingles * _ODD), first[some]))
    words = mix(shingles[:, None] + np.arange(1, number + 1, dtype=np.uint64) * _ODD)
    return node, check, majority(words, counts)


def odd_sketches(shingles: np.ndarray, counts: np.ndarray, words: int = 16) -> np.ndarray:
    """Parities of the hashes in 64 * words cells: two differ in no more cells than their sets in elements."""
    cell = np.repeat(np.arange(len(counts)), counts) * (64 * words) + (mix(shingles) % np.uint64(64 * words)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(counts) * 64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(len(counts), words)


def similar_pairs(sets: list[np.ndarray], look: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs i < j with look[i, j] whose Jaccard similarity is `least` or more."""
    size = np.array([len(s) for s in sets])
    sketch, root = odd_sketches(np.concatenate(sets), size), list(range(len(sets)))
    most = (size[:, None] + size[None]) * ((1 - least) / (1 + least)) + 1e-9  # elements that may be in one of both
    apart = np.zeros((len(sets), len(sets)), np.int32)
    for w in sketch.T:
        apart += np.bitwise_count(w[:, None] ^ w[None])
    i, j = np.nonzero(np.triu(look & (apart <= most) & (np.abs(size[:, None] - size[None]) <= most), 1))
    order = np.argsort(apart[i, j], kind="stable")

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q and 2 * len(np.union1d(sets[x], sets[y])) - size[x] - size[y] <= most[x, y]:
            root[max(p, q)] = min(p, q)
            a.append(x)
            b.append(y)
    return a, b


def bit_share(least: float) -> float:
    """The share of fingerprint bits in which sets of a similarity differ: that of their angle."""
    return math.acos(2 * least / (1 + least)) / math.pi


def number_of_fingerprints(least: float, parts: int, miss: float = 0.004) -> int:
    """So many fingerprints of `parts` segments that sets of similarity `least` share a variant of none with a chance of `miss`."""
    p = bit_share(least)
    hit = lambda n: (1 - p) ** n + n * p * (1 - p) ** (n - 1)
    return math.ceil(math.log(miss) / sum(math.log(1 - hit(m.bit_count())) for m in segments(parts)))


def _candidates(classes: DataFrame, number: int, parts: int, bits: int) -> DataFrame:
    """Edges (a, b) over nodes whose fingerprints share a variant and are near in the two they are compared by."""
    routes = Routes(segments(parts))

    def rows(batches):
        def group(node, x, y, route):
            return (x.view(np.uint64) & routes.masks[route % len(routes)]) + route.astype(np.uint64) * _ODD

        for node, x, y, route in whole_groups(batches, group):
            row, key = routes.variants(x.view(np.uint64), route % len(routes), route)
            a, b = linked(node, row, key, [x, y], bits)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    index = classes.select("node", "fps", F.explode(F.sequence(F.lit(0), F.lit(number * len(routes) - 1))).alias("route"))
    at = F.expr(f"route div {len(routes)}").cast("int")
    index = index.select("node", F.element_at("fps", at + 1).alias("x"), F.element_at("fps", (at + 1) % number + 1).alias("y"), F.col("route").cast("short").alias("route"))
    dealt = [F.col("route"), F.col("x").bitwiseAND(routes.mask((F.col("route") % len(routes)).cast("int")))]
    return index.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(rows, "a long, b long")


_TILE = "tile string, side int, own long, node long, shingles binary"


def _tiles(sets: DataFrame, least: float) -> DataFrame:
    """Verified edges (a, b) among the rows (_TILE) of each tile.

    Rows of one side are compared with each other on side 0 only; rows of equal `own`, which
    are connected already, never are.
    """

    def rows(batches):
        held, name = [], None

        def done():
            if len(held) > 1:
                side, own, nodes, data = zip(*held, strict=True)
                side, own = np.array(side), np.array(own)
                look = ((side[:, None] != side[None]) | (side[:, None] == 0)) & (own[:, None] != own[None])
                if look.any():
                    a, b = similar_pairs([np.frombuffer(s, np.uint64) for s in data], look, least)
                    yield pa.record_batch([pa.array([nodes[i] for i in a], pa.int64()), pa.array([nodes[i] for i in b], pa.int64())], names=["a", "b"])

        for batch in batches:
            for tile, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tile != name:
                    yield from done()
                    held, name = [], tile
                held.append(row)
        yield from done()

    return sets.select(*[c.split()[0] for c in _TILE.split(", ")]).repartition("tile").sortWithinPartitions("tile").mapInArrow(rows, "a long, b long")


_SHINGLES = 1 << 22  # in a block of sets that a task compares with another


def _number(block: int) -> Column:
    """How many blocks sets need that have `block` sets and _SHINGLES shingles each, on average."""
    return F.ceil(F.greatest(F.count("*") / block, F.sum(F.col("n").cast("long")) / _SHINGLES)).cast("int")


def _first_tiles(sets: DataFrame) -> DataFrame:
    """Each block of a cluster, and its first block again beside every other: rows grow with the cluster only."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = sets.withColumn("block", own).withColumn("number", F.explode(tiles)).withColumn("own", F.col("node"))
    return dealt.withColumn("side", (F.col("block") != F.col("number")).cast("int")).withColumn("tile", F.concat_ws("/", "cluster", "number"))


def _unconnected(members: DataFrame, roots: DataFrame, least: float, block: int) -> tuple[DataFrame, DataFrame] | None:
    """(sets, sides) of clusters of several blocks that are not connected yet, if any.

    sets has (node, key, own, name): its component and block.  A component of `block` sets or
    more has blocks of its own, others share theirs.  sides has (name, tile, side): two
    blocks meet unless they are of one component or no sizes of theirs can be similar.
    """
    wide = members.where("blocks > 1").join(roots, "node", "left").select("node", "key", "n", "cluster", F.coalesce("root", "node").alias("own"))
    apart = wide.groupBy("cluster").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high")
    wide = saved(wide.join(apart.select("cluster"), "cluster", "left_semi"), "unconnected")
    if wide.isEmpty():
        return None
    sizes = wide.groupBy("own").agg((F.count("*") >= block).alias("big"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.0001 / least)).cast("int")  # similar sets are in one or in adjacent ones
    wide = wide.join(sizes, "own").withColumn("owner", F.when(F.col("big"), F.col("own")).otherwise(F.lit(0))).withColumn("band", band)
    of = ["cluster", "big", "owner", "band"]
    place = F.pmod(F.xxhash64(F.when(F.col("big"), F.col("node")).otherwise(F.col("own"))), F.col("number"))
    wide = wide.join(wide.groupBy(of).agg(_number(block).alias("number")), of)
    wide = saved(wide.select("node", "key", "own", *of, F.concat_ws("/", *of, place).alias("name")), "blocks")
    low = wide.select("name", *of).distinct()
    high = low.select(*[F.col(c).alias(f"other_{c}") for c in low.columns])
    meet = (F.col("cluster") == F.col("other_cluster")) & (F.col("name") <= F.col("other_name")) & (F.abs(F.col("band") - F.col("other_band")) <= 1)
    meet &= ~(F.col("big") & F.col("other_big") & (F.col("owner") == F.col("other_owner")))
    pairs = low.join(high, meet).select("name", "other_name", F.concat_ws(" ", "name", "other_name").alias("tile"))
    pairs = saved(pairs, "pairs-of-blocks")
    same = F.col("name") == F.col("other_name")
    sides = pairs.select("name", "tile", F.when(same, 0).otherwise(1).alias("side"))
    return wide, sides.unionByName(pairs.where(~same).select(F.col("other_name").alias("name"), "tile", F.lit(2).alias("side")))


def similar_texts(rows: DataFrame, least: float = 0.8, shingle: int = 5, parts: int | None = None, block: int = 256) -> tuple[DataFrame, DataFrame | None]:
    """(own, roots) of rows (key, doc_id, text): own has key, doc_id, and node and check, two hashes
    of the row's shingle set; roots has (node, check, root) of all sets in groups that are linked at
    `least` or more, if any.  Sets of one node but another check, a collision of 64 bits, stay apart.

    1. Each distinct set has several independent fingerprints.  Sets of similarity 0.8 differ
       in 15 % of the bits, so a segment of 21 bits is equal but for one with a chance of
       0.15: of 12 fingerprints of 3 segments none is with a chance of 0.004, and such a pair
       is missed.  From 34 million rows on there are 78 fingerprints of 2 segments, which
       find as much with fewer unrelated sets a key; parts says how many segments.
    2. Sets that share a variant, and two of whose fingerprints differ in at most so many of
       128 bits as sets of the similarity and 4 standard deviations, are candidates; what
       they connect is a cluster.
    3. All sets of a cluster are compared in whole, in tiles of two blocks of about `block`
       sets; sketches of parities skip what can't reach the similarity.  First each block is
       compared with itself and with the cluster's first one, which connects near copies
       of one text, however many: work grows with their number.  Then the tiles whose blocks
       are not of one component and hold sets of similar sizes are.
    """
    small_batches(rows.sparkSession)
    if parts is None:
        parts = 3 if rows.count() <= 32 << 20 else 2
    number, p = number_of_fingerprints(least, parts), bit_share(least)
    bits = math.ceil(128 * p + 4 * math.sqrt(128 * p * (1 - p)))

    def sign(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                shingles, first = shingle_sets(part.column(2), shingle)
                node, check, fps = set_fingerprints(shingles, first, number)
                lists = pa.ListArray.from_arrays(np.arange(0, fps.size + 1, number, dtype=np.int32), pa.array(fps.view(np.int64).ravel()))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(np.diff(first).astype(np.int32)), lists], names=["key", "doc_id", "node", "check", "n", "fps"])

    own = saved(rows.select("key", "doc_id", "text").mapInArrow(sign, f"key {rows.schema['key'].dataType.simpleString()}, doc_id long, node long, check long, n int, fps array<long>"), "nodes")
    classes = own.where("n > 0").groupBy("node").agg(F.min_by("fps", "check").alias("fps"))
    clusters = components(_candidates(classes, number, parts, bits))
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "cluster")
    first = own.where("n > 0").groupBy("node").agg(F.min(F.struct("check", "key", "n")).alias("least"))
    members = saved(first.join(clusters, "node").select("node", "least.*", "cluster"), "members")
    if members.isEmpty():
        return own, None
    members = saved(members.join(members.groupBy("cluster").agg(_number(block).alias("blocks")), "cluster"), "representatives")

    def sets(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                shingles, first = shingle_sets(part.column(0), shingle)
                data = [shingles[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.record_batch([*part.columns[1:], pa.array(data, pa.binary())], names=[*part.schema.names[1:], "shingles"])

    def with_sets(of: DataFrame, columns: str) -> DataFrame:
        names = [c.split()[0] for c in columns.split(", ")]
        picked = rows.select("key", "text").join(of, "key").dropDuplicates(["key"]).select("text", *names)
        return picked.mapInArrow(sets, f"{columns}, shingles binary")

    roots = components(_tiles(_first_tiles(with_sets(members, "node long, cluster long, blocks int")), least))
    rest = _unconnected(members, roots, least, block)
    if rest:
        edges = _tiles(with_sets(rest[0], "node long, own long, name string").join(rest[1], "name"), least)
        roots = components(edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return own, roots.join(members.select("node", "check"), "node")


def distinct_documents(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the least doc_id, a null one last.

    Texts whose sets of `shingle`-word shingles have a Jaccard similarity of `least` or more
    are linked.  Texts without words (null, empty, blank) are copies of each other.  Columns
    stay as they are; repeated and null ids don't matter, as rows are told apart by id and
    text.  Of rows of one id and text that is kept whose other columns, as JSON, come first.
    """
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own, roots = similar_texts(rows, least, shingle)
    first = own.groupBy("node", "check").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    if roots is not None:
        group = F.when(F.col("root").isNull(), F.struct("node", "check")).otherwise(F.struct(F.col("root").alias("node"), F.lit(None).cast("long").alias("check")))
        first = first.join(roots, ["node", "check"], "left").groupBy(group.alias("group")).agg(F.min("first").alias("first"))
    name = fresh("row_key", docs.columns)
    kept = first.select(F.col("first.key").alias(name))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])) if others else F.lit("")
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    of_key = docs.withColumn(name, row_key(id_col, text_col)).join(kept, name, "left_semi").groupBy(name).agg(F.min_by(whole, order).alias("row"))
    return of_key.select([F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
