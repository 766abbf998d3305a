"""Expressions to one DataFrame plan.

Equal subtrees of all expressions are computed once.  Nodes are taken in rounds; a round
takes all that is ready and partitioned alike, and prefers the partitioning of the round
before, so that changes between securities and days, each a shuffle, are few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from factorweave.functions.stats import DAY, INDUSTRY, SECU, finite
from factorweave.plans.ast import ExpressionError, Node, parse


def schedule(trees: list[Node]) -> list[list[Node]]:
    """Rounds of distinct operator nodes; those of a round share their partitioning."""
    todo = {str(x): x for t in trees for x in t.walk() if x.op is not None}
    done: set[str] = set()
    rounds: list[list[Node]] = []
    last: tuple[str, ...] = ()
    while todo:
        ready = [x for x in todo.values() if all(c.op is None or str(c) in done for c in x.children)]
        plain = [x for x in ready if not x.spec.keys]
        by_keys: dict[tuple[str, ...], list[Node]] = {}
        for x in ready:
            by_keys.setdefault(x.spec.keys[:1], []).append(x)
        keys = () if plain else last if last in by_keys else max(by_keys, key=lambda k: len(by_keys[k]))
        now = plain or by_keys[keys]
        last = keys or last
        rounds.append(now)
        for x in now:
            done.add(str(x))
            del todo[str(x)]
    return rounds


def _by_group(df: DataFrame, keys: tuple[str, ...], nodes: list[Node], place: dict[str, str], prefix: str) -> DataFrame:
    """df with the results of group kernels over the rows of each group; one call for all outputs of the same inputs."""
    if missing := [k for k in keys if k not in df.columns]:
        raise ExpressionError(f"the panel has no column {', '.join(missing)}")
    calls: dict[tuple, dict[int, str]] = {}
    for x in nodes:
        inputs = tuple(place[str(c)] for c in x.children)
        place[str(x)] = calls.setdefault((x.spec.group, inputs), {}).setdefault(x.spec.output, f"{prefix}_{len(place)}")
    names = [c for outputs in calls.values() for c in outputs.values()]
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in names]])
    arrow, own = to_arrow_schema(schema), df.columns

    history = keys == (SECU,)

    def rows(key, table):
        table, out = table.sort_by(DAY if history else SECU), {}
        for (kernel, inputs), outputs in calls.items():
            x = [np.asarray(table[c].to_numpy(zero_copy_only=False), float) for c in inputs]
            have = np.full(table.num_rows, True) if history else ~np.any([np.isnan(v) for v in x], axis=0)
            known = all(k.is_valid for k in key) and have.any()
            with np.errstate(all="ignore"):
                got = kernel(*[v[have] for v in x]) if known else None
            got = got if isinstance(got, tuple) else (got,)
            for i, name in outputs.items():
                value = np.full(table.num_rows, np.nan)
                if known:
                    value[have] = got[i]
                out[name] = pa.array(np.where(np.isfinite(value), value, np.nan), from_pandas=True)
        return pa.Table.from_arrays([*[table[c].cast(arrow.field(c).type) for c in own], *[out[c] for c in names]], schema=arrow)

    return df.groupBy(*keys).applyInArrow(rows, schema)


def evaluate(panel: DataFrame, expressions: list[str | Node] | dict[str, str | Node], keep: list[str] | None = None, float32: bool = False) -> DataFrame:
    """(SecuCode, TradingDay, keep..., one column for each expression).

    Columns are named by their expression, in the spelling with effective window lengths, or
    by the keys of a dict.  Panel columns are read as doubles, NaN and infinity as missing.
    """
    named = expressions if isinstance(expressions, dict) else {str(e): e for e in expressions}
    trees = {k: parse(v) if isinstance(v, str) else v for k, v in named.items()}
    if not isinstance(expressions, dict):
        trees = {str(t): t for t in trees.values()}
    wanted = sorted({c for t in trees.values() for c in t.columns()})
    if missing := [c for c in wanted if c not in panel.columns]:
        raise ExpressionError(f"the panel has no column {', '.join(missing)}")
    industry = [INDUSTRY] if INDUSTRY in panel.columns else []
    keep = [c for c in keep or [] if c not in (SECU, DAY, *industry)]
    df = panel.select(SECU, DAY, *industry, *[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)], *[finite(F.col(f"`{c}`")).alias(f"__leaf{i}") for i, c in enumerate(wanted)])
    place = {c: f"__leaf{i}" for i, c in enumerate(wanted)}
    for r, nodes in enumerate(schedule(list(trees.values()))):
        helpers, results, shared = {}, {}, {}
        kernels = [x for x in nodes if x.spec.group]
        for k, x in enumerate(nodes):
            if x.spec.group:
                continue
            inputs = [F.col(place[str(c)]) for c in x.children]
            needs, result = x.spec.build(*inputs, *([x.n] if x.spec.takes_n else []))
            own = {h: shared.setdefault(str(c), f"__h{r}_{k}_{h}") for h, c in needs.items()}  # equal helpers are one column
            helpers |= {own[h]: c for h, c in needs.items()}
            results[f"__v{r}_{k}"] = result(**{h: F.col(n) for h, n in own.items()})
            place[str(x)] = f"__v{r}_{k}"
        df = df.withColumns(helpers) if helpers else df
        # each result is a column before finite() reads it twice: half the code, which the JVM doesn't compile beyond 8,000 bytes a method
        df = df.withColumns(results).withColumns({c: finite(F.col(c)) for c in results}).drop(*helpers)
        for i, keys in enumerate(sorted({x.spec.keys for x in kernels})):
            df = _by_group(df, keys, [x for x in kernels if x.spec.keys == keys], place, f"__g{r}_{i}")
    as_ = "float" if float32 else "double"
    return df.select(SECU, DAY, *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(place[str(t)]).cast(as_).alias(name) for name, t in trees.items()])
