"""Rolling expressions over a stream of bars, security by security.

The state of a security is a buffer of its last bars, as many as the longest chain of
windows looks back on, and the bars that still wait for late ones.  Each new bar gives one row, equal to
that of the batch evaluation of the same bars.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorweave.functions.kernels import KERNELS, finite
from factorweave.functions.stats import DAY, SECU
from factorweave.plans.ast import ExpressionError, Node, parse
from factorweave.plans.population import has_kernels


def look_back(tree: Node) -> int:
    """How many earlier rows of a security a value depends on."""
    if tree.op is None:
        return 0
    own = tree.n if tree.op in ("ts_shift", "ts_diff") else (tree.n or _fixed(tree.op)) - 1
    return own + max(look_back(c) for c in tree.children)


def _fixed(op: str) -> int:
    """The window of an operator without a length of its own: those of ts_corr_20D and its like, 1 for pairs."""
    return int(op[8:-1]) if op.startswith("ts_corr_") else 1


def values_of(trees: list[Node], columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The trees over one security's columns, in order of day; equal subtrees once."""
    known = {c: finite(np.asarray(x, float)) for c, x in columns.items()}

    def value(x: Node) -> np.ndarray:
        if str(x) not in known:
            with np.errstate(all="ignore"):
                known[str(x)] = finite(KERNELS[x.op](*map(value, x.children), *([x.n] if x.n is not None else [])))
        return known[str(x)]

    return [value(t) for t in trees]


def rolling(bars: DataFrame, expressions: dict[str, str | Node], grace_days: int = 0, timeout: str | None = None) -> DataFrame:
    """(SecuCode, TradingDay, a column for each expression) for a stream of bars.

    Expressions look at one security at a time (time-series and pair operators).  A bar is put out
    once a bar `grace_days` later or more has come; bars that come in any order until then
    take their place.  A bar of a day that was put out already, or repeated, is late and left out.
    timeout, such as "30 minutes": a security without a new bar for so long has its waiting bars put
    out; its buffer stays, so that it can go on.  Null days or securities are left out.
    """
    trees = {k: parse(e) if isinstance(e, str) else e for k, e in expressions.items()}
    if wrong := [str(t) for t in trees.values() if not has_kernels(t)]:
        raise ExpressionError(f"not over one security at a time: {', '.join(wrong)}")
    leaves = sorted({c for t in trees.values() for c in t.columns()})
    back = max(map(look_back, trees.values()), default=0)
    wait = None if timeout is None else int(pd.Timedelta(timeout) / pd.Timedelta(milliseconds=1))
    names = list(trees)

    def put_out(key, held: list[tuple], new: list[tuple]) -> pd.DataFrame:
        """Rows of the bars `new`, which follow those of the buffer."""
        rows = [*held, *new]
        columns = {c: np.array([r[1 + i] for r in rows], float) for i, c in enumerate(leaves)}
        out = {SECU: [key[0]] * len(new), DAY: [r[0] for r in new]}
        for name, x in zip(names, values_of(list(trees.values()), columns), strict=True):
            out[name] = pd.Series(x[len(held) :]).astype(object).where(~np.isnan(x[len(held) :]), None)
        return pd.DataFrame(out)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting, last = pickle.loads(state.get[0]) if state.exists else ([], {}, None)
        if state.hasTimedOut:
            ready = sorted(waiting)
        else:
            for pdf in frames:
                for day, *own in pdf[[DAY, *leaves]].itertuples(index=False, name=None):
                    day = pd.Timestamp(day).date()
                    if (last is None or day > last) and day not in waiting:
                        waiting[day] = (day, *[float("nan") if x is None else float(x) for x in own])
            until = max(waiting, default=date.min)
            ready = sorted(d for d in waiting if d + timedelta(days=grace_days) <= until)
        if ready:
            new = [waiting.pop(d) for d in ready]
            yield put_out(key, held, new)
            held, last = [*held, *new][-back:] if back else [], ready[-1]
        state.update((pickle.dumps((held, waiting, last)),))
        if wait is not None and waiting:
            state.setTimeoutDuration(wait)

    own = bars.select(SECU, F.col(DAY).cast("date").alias(DAY), *[F.col(f"`{c}`").cast("double").alias(c) for c in leaves]).where(f"{SECU} is not null and {DAY} is not null")
    schema = f"{SECU} {dict(own.dtypes)[SECU]}, {DAY} date, " + ", ".join(f"`{n}` double" for n in names)
    kind = GroupStateTimeout.ProcessingTimeTimeout if wait is not None else GroupStateTimeout.NoTimeout
    return own.groupBy(SECU).applyInPandasWithState(update, schema, "state binary", "append", kind)
