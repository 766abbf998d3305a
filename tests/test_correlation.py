import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorweave.functions.stats import corr
from factorweave.operators import correlation as co
from factorweave.operators import search


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 1e6 * np.arange(12)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3], x[:, 7] = 5.0, np.nan
    x[:150, 4], x[150:, 5] = np.nan, np.nan  # never both
    return pd.DataFrame(x, columns=[f"c {i}." for i in range(12)])


@pytest.mark.parametrize("together", [1024, 5])
def test_matrix_equals_pandas_and_the_aggregates(spark, frame, together):
    cols = list(frame.columns)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    df = df.unionByName(df.limit(1).withColumn("c 0.", F.lit(float("inf"))))
    got = {(r["a"], r["b"]): r["corr"] for r in co.correlation_matrix(df, cols, together).collect()}
    assert set(got) == set(itertools.combinations(cols, 2))
    one = df.agg(*[corr(F.when(F.abs(F.col(f"`{a}`")) < float("inf"), F.col(f"`{a}`")), F.col(f"`{b}`")).alias(f"r{i}") for i, (a, b) in enumerate(got)]).first()
    for i, pair in enumerate(got):
        want = one[f"r{i}"]
        assert (got[pair] is None) == (want is None) and (want is None or got[pair] == pytest.approx(want, abs=1e-7))


def test_matrix_of_many_columns_is_one_pass(spark):
    df = spark.range(200, numPartitions=3).select(*[F.when(F.col("id") % (i + 2) != 0, F.sin(F.col("id") * (i + 1))).alias(f"f{i}") for i in range(150)])
    out = co.correlation_matrix(df, df.columns)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r["a"], r["b"]): r["corr"] for r in out.collect()}
    want = df.toPandas().corr()
    assert len(got) == 150 * 149 // 2 and all(v == pytest.approx(want[a][b], abs=1e-9) for (a, b), v in got.items())


def test_few_columns_and_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert co.correlation_matrix(df, ["a"]).collect() == [] and [tuple(r) for r in co.correlation_matrix(df, ["a", "b"]).collect()] == [("a", "b", None)]


@pytest.mark.parametrize("block", [512, 7])
def test_correlated_pairs_and_the_kept_ones(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 30))
    vectors = {f"v{i}": (base[i % 12] * rng.choice([-2, 3]) + rng.normal(size=30) * rng.choice([0.05, 0.6])).tolist() for i in range(60)} | {"zero": [0.0] * 30, "flat": [4.0] * 30}
    df = spark.createDataFrame(list(vectors.items()), "factor string, pc array<double>").repartition(4)
    want = set()
    for a, b in itertools.combinations(sorted(vectors), 2):
        with np.errstate(all="ignore"):
            want |= {(a, b)} if abs(np.corrcoef(vectors[a], vectors[b])[0, 1]) > 0.9 else set()
    got = [tuple(sorted(r)) for r in co.correlated(df, 0.9, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    order, kept = random.Random(1).sample(sorted(vectors), len(vectors)), []
    for n in order:
        if not any(tuple(sorted((n, k))) in want for k in kept):
            kept.append(n)
    assert co.independent(order, got) == kept == search.uncorrelated(order, df, 0.9)


def test_wheel_draws_by_weight_without_replacement():
    rng, weights = random.Random(3), [1.0, 0.0, 2.0, 5.0, 2.0]
    wheel = search.Wheel(weights)
    first, pairs = Counter(), Counter()
    for _ in range(20_000):
        a, b = wheel.draw(2, rng)
        first[a] += 1
        pairs[a, b] += 1
    assert first[1] == 0 and all(a != b for a, b in pairs)
    for i, w in enumerate(weights):
        assert first[i] / 20_000 == pytest.approx(w / 10, abs=0.015)
        for j, v in enumerate(weights):
            if i != j and w:
                assert pairs[i, j] / 20_000 == pytest.approx(w / 10 * v / (10 - w), abs=0.015)
    assert sorted(wheel.draw(9, rng)) == [0, 1, 2, 3, 4] and wheel.draw(9, rng)[-1] == 1
    assert wheel.sums[wheel.size :][:5] == weights
    assert len({tuple(search.Wheel([0.0, 0.0, 0.0]).draw(2, rng)) for _ in range(200)}) == 6
    assert search.Wheel([]).draw(3, rng) == []
    big = search.Wheel([1.0] * 100_000)
    assert len({i for _ in range(3000) for i in big.draw(2, rng)}) > 5500
