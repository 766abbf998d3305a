"""Evaluation of a whole population of expressions with stored subtrees.

The panel is stored in buckets of SecuCode, so rounds of time-series operators need no
exchange.  Operators across a day do, and so their results are computed once for the whole
population, in a few wide plans, and stored in the same buckets; so are subtrees that many trees
share, as far as a budget of bytes goes.  Batches then read stored columns in place of subtrees,
exchange nothing, and write their values; one exchange by day scores all of them.

What is left of a tree is computed over arrays, a security's history at a time: a
batch of 40 trees asks for some 100 rolling windows, for which window functions and lambdas take
tens of times longer.  Operators without an array kernel go through the compiler.  Without stored
subtrees, layers of the two take turns in one plan, and arrays hold many histories at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorweave.functions.kernels import JUMPS, KERNELS, finite
from factorweave.functions.stats import DAY, INDUSTRY, SECU
from factorweave.plans.ast import COLUMNS, ExpressionError, Node, column, parse
from factorweave.plans.compiler import evaluate
from factorweave.sources.shared import Store


@contextmanager
def _joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Lets joins on (SecuCode, TradingDay) use buckets of SecuCode; the session is as before afterwards."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def operators_of(tree: Node) -> dict[str, Node]:
    """The distinct operator nodes of a tree by their expression, children before parents."""
    return {str(x): x for x in tree.walk() if x.op is not None}


def across(node: Node) -> bool:
    """Whether an operator looks across the securities of a day."""
    return node.spec.keys[:1] == (DAY,)


def worth_storing(trees: list[Node], most: int) -> list[Node]:
    """At most `most` subtrees to store: all that look across a day, then those that save the most operators.

    A shared subtree saves its operators for each tree but the first that has it; one that occurs
    only inside a larger one of as many trees saves nothing.
    """
    nodes: dict[str, Node] = {}
    uses: Counter[str] = Counter()
    for own in map(operators_of, trees):
        nodes |= own
        uses.update(own.keys())
    inside = {str(c) for k, x in nodes.items() for c in x.children if c.op is not None and uses[str(c)] == uses[k]}
    day = sorted((k for k, x in nodes.items() if across(x)), key=lambda k: (-uses[k], k))
    shared = [k for k, x in nodes.items() if uses[k] > 1 and x.spec.keys and not across(x) and k not in inside]
    shared.sort(key=lambda k: (-(uses[k] - 1) * len(operators_of(nodes[k])), k))
    return [nodes[k] for k in [*day, *shared][:most]]


def over_arrays(panel: DataFrame, names: dict[str, Node], keep: list[str] | None = None) -> DataFrame:
    """(SecuCode, TradingDay, keep..., a column for each tree), by array kernels; for trees of which has_kernels() is true.

    A group is one security's rows, in order of day; equal subtrees are computed once.
    """
    keep, leaves = keep or [], sorted({c for t in names.values() for c in t.columns()})
    own = panel.select(SECU, DAY, *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").cast("double").alias(f"leaf{i}") for i, c in enumerate(leaves)])
    schema = pa.schema([*_arrow_fields(own.select(SECU, DAY, *[f"keep{i}" for i in range(len(keep))])), *[pa.field(f"v{i}", pa.float64()) for i in range(len(names))]])
    trees = list(names.values())

    def rows(table):
        table = table.sort_by(DAY)
        known = {c: finite(np.asarray(table[f"leaf{i}"].to_numpy(zero_copy_only=False), float)) for i, c in enumerate(leaves)}

        def value(x: Node) -> np.ndarray:
            name = str(x)
            if name not in known:
                with np.errstate(all="ignore"):
                    known[name] = finite(KERNELS[x.op](*map(value, x.children), *([x.n] if x.n is not None else [])))
            return known[name]

        out = [pa.array(value(t), from_pandas=True) for t in trees]
        return pa.Table.from_arrays([*[table[c] for c in schema.names[: 2 + len(keep)]], *out], schema=schema)

    types = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[: 2 + len(keep)]], *[f"v{i} double" for i in range(len(names))]])
    out = own.groupBy(SECU).applyInArrow(rows, types)
    return out.select(SECU, DAY, *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"v{i}").alias(c) for i, c in enumerate(names)])


def _arrow_fields(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def over_histories(panel: DataFrame, names: dict[str, Node], keep: list[str] | None = None) -> DataFrame:
    """over_arrays(), for panels that lie in any order: many short histories are computed in one call.

    Tasks stream their rows in order of security and day.  A call takes the securities that an
    Arrow batch ends, with missing rows between them, so that no window reaches into another's history.
    """
    keep, leaves = keep or [], sorted({c for t in names.values() for c in t.columns()})
    own = panel.select(SECU, DAY, *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").cast("double").alias(f"leaf{i}") for i, c in enumerate(leaves)])
    schema = pa.schema([*_arrow_fields(own.select(SECU, DAY, *[f"keep{i}" for i in range(len(keep))])), *[pa.field(f"v{i}", pa.float64()) for i in range(len(names))]])
    trees = list(names.values())
    space = max([1, *[x.n for t in trees for x in t.walk() if x.op in JUMPS]])  # a window finds one missing row; a lag jumps over less than it

    def computed(table: pa.Table, place: np.ndarray) -> pa.Table:
        at = np.arange(table.num_rows) + space * place

        def spaced(x: np.ndarray) -> np.ndarray:
            out = np.full(at[-1] + 1, np.nan)
            out[at] = finite(x)
            return out

        known = {c: spaced(np.asarray(table[f"leaf{i}"].to_numpy(), float)) for i, c in enumerate(leaves)}

        def value(x: Node) -> np.ndarray:
            name = str(x)
            if name not in known:
                with np.errstate(all="ignore"):
                    known[name] = spaced(KERNELS[x.op](*map(value, x.children), *([x.n] if x.n is not None else []))[at])
            return known[name]

        out = [pa.array(value(t)[at], from_pandas=True) for t in trees]
        return pa.Table.from_arrays([*[table[c].cast(schema.field(c).type) for c in schema.names[: 2 + len(keep)]], *out], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0][SECU][0].as_py() == batch[SECU][-1].as_py():
                continue  # one security, which may go on
            table = pa.Table.from_batches(held)
            place = _runs(table[SECU])
            cut = int(np.searchsorted(place, place[-1]))
            yield from computed(table[:cut], place[:cut]).to_batches()
            held = table[cut:].to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from computed(table, _runs(table[SECU])).to_batches()

    types = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[: 2 + len(keep)]], *[f"v{i} double" for i in range(len(names))]])
    out = own.repartition(SECU).sortWithinPartitions(SECU, DAY).mapInArrow(rows, types)
    return out.select(SECU, DAY, *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"v{i}").alias(c) for i, c in enumerate(names)])


def _runs(keys: pa.ChunkedArray) -> np.ndarray:
    """0, 0, ..., 1, ...: the number of each row's run of equal keys, nulls alike."""
    codes = keys.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])])


def has_kernels(tree: Node) -> bool:
    """Whether a tree looks at one security at a time, by operators that have an array kernel."""
    return all(x.op in KERNELS for x in tree.walk() if x.op is not None)


def _rolls(tree: Node) -> bool:
    """Whether a tree of which has_kernels() is true looks at other rows than its own."""
    return any(x.spec.keys for x in tree.walk() if x.op is not None)


def _innermost(tree: Node) -> list[Node]:
    """The operators without an array kernel over operands of which has_kernels() is true."""
    inner = [x for c in tree.children for x in _innermost(c)]
    return inner or ([] if tree.op is None or tree.op in KERNELS else [tree])


def _placed(tree: Node, place: dict[str, str]) -> Node:
    """The tree with subtrees that have a place as columns."""
    if str(tree) in place:
        return column(place[str(tree)])
    return Node(tree.op, tree.name, tuple(_placed(c, place) for c in tree.children), tree.n) if tree.children else tree


def evaluate_many(panel: DataFrame, names: dict[str, str | Node], keep: list[str] | None = None, bucketed: bool = False) -> DataFrame:
    """evaluate() for many trees: what looks at one security at a time is computed over arrays.

    Layers of the two take turns: the operators that have no array kernel and whose operands have
    one go through the compiler, until arrays can do the rest.  Values agree with those of
    evaluate() but for rounding.  bucketed: the panel lies in buckets of SecuCode, which are used.
    """
    trees = {k: parse(t) if isinstance(t, str) else t for k, t in names.items()}
    if missing := sorted({c for t in trees.values() for c in t.columns()} - set(panel.columns)):
        raise ExpressionError(f"the panel has no column {', '.join(missing)}")
    arrays, made, keep = over_arrays if bucketed else over_histories, 0, keep or []
    while any(map(_innermost, trees.values())):
        for across_rows in (False, True):
            part = {str(x): x for t in trees.values() for x in _innermost(t)}
            if not across_rows:
                part = {str(c): c for x in part.values() for c in x.children if _rolls(c)}
            if not part:
                continue
            place = {k: f"inner{made + i}" for i, k in enumerate(part)}
            made += len(part)
            trees = {k: _placed(t, place) for k, t in trees.items()}
            used = {c for t in trees.values() for c in t.columns()} | set(keep)
            if any(INDUSTRY in x.spec.keys for t in trees.values() for x in t.walk() if x.op is not None):
                used.add(INDUSTRY)
            panel = (_compiled if across_rows else arrays)(panel, {place[k]: x for k, x in part.items()}, [c for c in panel.columns if c in used])
    return arrays(panel, trees, keep) if any(map(_rolls, trees.values())) else evaluate(panel, trees, keep)


def _compiled(panel: DataFrame, names: dict[str, Node], keep: list[str]) -> DataFrame:
    """evaluate() that also keeps the industry."""
    if INDUSTRY not in keep:
        return evaluate(panel, names, keep)
    own = panel.withColumn("kept_industry", F.col(INDUSTRY))
    return evaluate(own, names, [*[c for c in keep if c != INDUSTRY], "kept_industry"]).withColumnRenamed("kept_industry", INDUSTRY)


class Subtrees:
    """Stored values of subtrees over one panel, kept between batches and epochs until close().

    panel: unique keys (SecuCode, TradingDay), the leaf columns, and ret_col.  budget: bytes of
    stored subtrees; what doesn't fit is computed in the batches that need it.
    """

    def __init__(self, panel: DataFrame, ret_col: str = "ret", budget: int = 64 << 30, together: int = 60, buckets: int | None = None):
        self.spark, self.ret_col, self.together = panel.sparkSession, ret_col, together
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.store = Store(self.spark)
        self.keep = [c for c in (INDUSTRY, ret_col) if c in panel.columns]
        leaves = [c for c in panel.columns if c in COLUMNS and c not in self.keep]
        self.base = self.store.bucketed(panel.select(SECU, DAY, *self.keep, *leaves), SECU, DAY, self.buckets, "panel")
        self.most = budget // (8 * max(self.base.count(), 1))
        self.place: dict[str, tuple[int, str]] = {}  # expression: (number of its table, column)
        self.tables: dict[int, DataFrame] = {}
        self.made = 0

    def close(self) -> None:
        self.place.clear()
        self.tables.clear()
        self.store.close()

    @contextmanager
    def borrowed(self) -> Iterator[Subtrees]:
        """For a with block that leaves it open."""
        yield self

    def __enter__(self) -> Subtrees:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def read(self, tree: Node) -> Node:
        """The tree with stored subtrees as columns."""
        return _placed(tree, {k: c for k, (_, c) in self.place.items()})

    def panel_for(self, trees: list[Node]) -> DataFrame:
        """The panel with the columns that these trees, as read() gives them, need; joined bucket by bucket."""
        names = {c for t in trees for c in t.columns()}
        df = self.base.select(SECU, DAY, *self.keep, *[c for c in self.base.columns if c in names and c not in self.keep])
        stored: dict[int, list[str]] = {}
        for number, c in sorted(x for x in self.place.values() if x[1] in names):
            stored.setdefault(number, []).append(c)
        for number, own in stored.items():
            df = df.join(self.tables[number].select(SECU, DAY, *own), [SECU, DAY], "left")
        return df

    def values(self, names: dict[str, Node], keep: list[str] | None = None) -> DataFrame:
        """(SecuCode, TradingDay, keep..., a column for each tree)."""
        trees = {k: self.read(t) for k, t in names.items()}
        return evaluate_many(self.panel_for(list(trees.values())), trees, keep, bucketed=True)

    def prepare(self, trees: list[Node]) -> None:
        """Stores what is worth it for these trees and isn't there; what no longer fits and isn't needed goes."""
        wanted = {str(x): x for x in worth_storing(trees, self.most)}
        if len(self.place.keys() | wanted.keys()) > self.most:
            kept = {self.place[k][0] for k in wanted if k in self.place}
            self.place = {k: v for k, v in self.place.items() if v[0] in kept}
            self.tables = {n: t for n, t in self.tables.items() if n in kept}
        todo = {k: x for k, x in wanted.items() if k not in self.place}
        while todo:
            # those that need none of the others; operators across a day and others apart
            ready = [k for k, x in todo.items() if not any(str(c) in todo for c in x.walk() if c is not x)]
            kind = across(todo[ready[0]])
            ready = [k for k in ready if across(todo[k]) == kind]
            for a in range(0, len(ready), self.together):
                self._add({k: todo[k] for k in ready[a : a + self.together]})
            for k in ready:
                del todo[k]

    def _add(self, part: dict[str, Node]) -> None:
        number, self.made = self.made, self.made + 1
        columns = {k: f"sub{number}_{i}" for i, k in enumerate(part)}
        with _joined_by_bucket(self.spark):
            values = self.values({columns[k]: x for k, x in part.items()})
            self.tables[number] = self.store.bucketed(values, SECU, DAY, self.buckets, "subtrees")
        self.place |= {k: (number, c) for k, c in columns.items()}

    def scores(self, trees: list[Node], batch: int = 40) -> DataFrame:
        """(factor_name, ic, tvalue, valid_factor_size, days) of distinct trees, as operators.search.score_batch has them."""
        self.prepare(trees)
        folder = self.store.folder("values")
        parts = [trees[a : a + batch] for a in range(0, len(trees), batch)]
        with _joined_by_bucket(self.spark):
            for i, part in enumerate(parts):
                names = {f"f{k}": t for k, t in enumerate(part)}
                values = self.values(names, [self.ret_col]).where(F.col(self.ret_col).isNotNull())
                values.select(SECU, DAY, F.col(self.ret_col).alias("ret"), F.array(*names).alias("f")).write.parquet(f"{folder}/batch={i}")
        return scores_of(self.spark.read.parquet(folder), parts)


def scores_of(values: DataFrame, parts: list[list[Node]]) -> DataFrame:
    """(factor_name, ic, tvalue, valid_factor_size, days) of the trees of batches, from (batch, SecuCode, TradingDay, ret, f: their values)."""
    daily = values.groupBy("batch", DAY).applyInArrow(_daily_scores, f"batch int, {DAY} date, v array<double>")
    got = daily.groupBy("batch").applyInArrow(_batch_scores, "batch int, k int, ic double, tvalue double, valid_factor_size long, days long")
    trees = [(i, k, str(t)) for i, part in enumerate(parts) for k, t in enumerate(part)]
    schema = pa.schema({"batch": pa.int32(), "k": pa.int32(), "factor_name": pa.string()})
    names = values.sparkSession.createDataFrame(pa.table(list(map(list, zip(*trees))), schema=schema))  # no task of Python for it
    return names.join(got, ["batch", "k"], "left").select("factor_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ic", "tvalue", "valid_factor_size", "days")])


def _daily_scores(key, table):
    """The mean product of held z-score and return of each factor of a batch on one day; its rows are the day's securities."""
    rows, table = table.num_rows, table.sort_by(SECU)  # sums in one order, so that runs agree to the last bit
    x = table["f"].combine_chunks()
    x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(rows, -1)
    ret = np.asarray(table["ret"].to_numpy(zero_copy_only=False), float)[:, None]
    known = ~np.isnan(x)
    n = known.sum(0)
    some = np.maximum(n, 1)
    off = np.where(known, x - np.where(known, x, 0.0).sum(0) / some, 0.0)
    dev = np.sqrt((off * off).sum(0) / some)
    varies = (n > 0) & (np.where(known, x, -np.inf).max(0) > np.where(known, x, np.inf).min(0)) & (dev > 0)
    product = np.clip(off / np.where(varies, dev, 1.0), -3.0, 3.0) * ret
    mean = np.where(known, product, 0.0).sum(0) / some
    v = pa.ListArray.from_arrays(pa.array([0, x.shape[1]], pa.int32()), pa.array(mean, mask=~varies))
    return pa.table({"batch": pa.array([key[0].as_py()], pa.int32()), DAY: pa.array([key[1].as_py()], pa.date32()), "v": v})


def _batch_scores(key, table):
    """Mean in %, t value and count of the daily scores of each factor of a batch; its rows are days."""
    days, table = table.num_rows, table.sort_by(DAY)
    x = np.asarray(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(days, -1)
    known = ~np.isnan(x)
    n = known.sum(0)
    mean = np.where(known, x, 0.0).sum(0) / np.maximum(n, 1)
    off = np.where(known, x - mean, 0.0)
    dev = np.sqrt((off * off).sum(0) / np.maximum(n - 1, 1))
    varies = (n > 1) & (dev > 0)
    t = np.where(varies, mean * np.sqrt(n) / np.where(varies, dev, 1.0), 0.0)
    k = x.shape[1]
    return pa.table({"batch": pa.array([key[0].as_py()] * k, pa.int32()), "k": pa.array(range(k), pa.int32()), "ic": mean * 100, "tvalue": t, "valid_factor_size": n.astype(np.int64), "days": pa.array([days] * k, pa.int64())})
