"""Narrower column types, chosen from one pass over the values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WHOLE = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


@dataclass(frozen=True)
class Narrowing:
    """What one column becomes; loss: the largest relative error that this makes."""

    column: str
    old: str
    new: str
    least: float | int | None
    most: float | int | None
    null_share: float
    loss: float


def plan_narrowing(df: DataFrame, loss: float = 1e-7, whole: bool = True) -> list[Narrowing]:
    """For each numeric column the narrowest type that holds its values.

    Whole numbers take the first of byte, short, int and long that holds them exactly.  Doubles become
    whole numbers if all are (and `whole`, and none is NaN, infinite or -0.0), else floats if no
    value changes by more than `loss` of itself; 0 asks for exact ones.  Columns without a value
    stay.  One pass for all columns.
    """
    kinds = {c: t for c, t in df.dtypes if t in _WHOLE or t == "double"}
    if not kinds:
        return []
    parts = [F.count("*").alias("rows")]
    for i, (c, t) in enumerate(kinds.items()):
        x = F.col(f"`{c}`")
        parts += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"n{i}")]
        if t == "double":
            narrow = x.cast("float").cast("double")
            odd = F.isnan(x) | (F.abs(x) == float("inf"))
            error = F.when(odd, 0.0).when(narrow != x, F.abs(narrow - x) / F.abs(x)).otherwise(0.0)
            bare = odd | (x != F.floor(x)) | (F.abs(x) >= 2.0**62) | ((x == 0) & (x.cast("string") == "-0.0"))
            parts += [F.max(error).alias(f"e{i}"), F.max(bare).alias(f"b{i}")]
    r, out = df.agg(*parts).first(), []  # one row
    for i, (c, t) in enumerate(kinds.items()):
        lo, hi, n = r[f"lo{i}"], r[f"hi{i}"], r[f"n{i}"]
        new, lost = t, 0.0
        if n:
            if t in _WHOLE or (whole and not r[f"b{i}"]):
                new = next(k for k, bits in _WHOLE.items() if -(1 << bits - 1) <= int(lo) and int(hi) < 1 << bits - 1)
            elif r[f"e{i}"] <= loss:
                new, lost = "float", float(r[f"e{i}"])
        out.append(Narrowing(c, t, new, lo, hi, 1 - n / r["rows"] if r["rows"] else 0.0, lost))
    return out


def narrow(df: DataFrame, loss: float = 1e-7, whole: bool = True) -> DataFrame:
    """df with the types of plan_narrowing(); values stay, within `loss`."""
    new = {p.column: p.new for p in plan_narrowing(df, loss, whole) if p.new != p.old}
    return df.select(*[F.col(f"`{c}`").cast(new[c]).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])
