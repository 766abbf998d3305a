import math
import random
import statistics

import pytest

from factorweave.operators import search
from factorweave.operators.ic import with_return
from factorweave.plans.__main__ import return_to_explain
from factorweave.plans.compiler import evaluate
from factorweave.sources.panel import read_panel


def value(tree, panel):
    """The tree for every (security, day)."""
    return {(r[0], r[1]): r[2] for r in evaluate(panel, {"v": tree}).collect()}


def plain_fitness(values, returns):
    """ic, t, days and fitness of a factor from its values: z-scores of a day, held within 3, times the return."""
    by_day = {}
    for key, ret in returns.items():
        if ret is not None:
            by_day.setdefault(key[1], []).append((values[key], ret))
    daily = []
    for rows in by_day.values():
        known = [(f, r) for f, r in rows if f is not None]
        f = [x for x, _ in known]
        dev = statistics.pstdev(f) if len(f) > 1 and max(f) > min(f) else 0
        if dev > 0:
            mean = statistics.fmean(f)
            daily.append(statistics.fmean(max(-3.0, min(3.0, (x - mean) / dev)) * r for x, r in known))
    if not daily:
        return 0.0, 0.0, 0, 0.0
    ic, dev = 100 * statistics.fmean(daily), statistics.stdev(daily) if len(daily) > 1 else 0
    t = statistics.fmean(daily) / dev * math.sqrt(len(daily)) if dev else 0.0
    few = len(daily) < max(100, len(by_day) // 5)
    return ic, t, len(daily), 0.0 if few else abs(ic) + 3 * math.tanh(abs(t) / 3)


@pytest.fixture(scope="module")
def panel(spark, sf):
    return with_return(read_panel(spark, sf), "raw_close_open").persist()


def test_a_seeded_run_is_what_its_parts_give(spark, panel):
    """The last epoch's trees are those of the same draws in plain Python, and their fitness is the plain one."""
    run = search.Search(size=8, epochs=2, depth=2, seed=7)
    history = run.fit(panel, ["ts_mean(raw_close_close,20)"])
    rng = random.Random(7)
    trees = run.start(panel, rng, ["ts_mean(raw_close_close,20)"])
    assert {str(s.tree) for s in history[0]["scored"]} == {str(t) for t in trees}
    returns = {(r[0], r[1]): r[2] for r in panel.select("SecuCode", "TradingDay", "ret").collect()}
    for h in history:
        for s in h["scored"]:
            ic, t, days, fitness = plain_fitness(value(s.tree, panel), returns)
            assert s.days == days and (s.ic, s.tvalue, s.fitness) == (pytest.approx(ic, rel=1e-6, abs=1e-9), pytest.approx(t, rel=1e-6, abs=1e-9), pytest.approx(fitness, rel=1e-6, abs=1e-9)), str(s.tree)
        assert [(-s.fitness, str(s.tree)) for s in h["scored"]] == sorted((-s.fitness, str(s.tree)) for s in h["scored"])
    then = search.evolve(history[0]["scored"], 8, rng, 2, run.columns)
    assert {str(s.tree) for s in history[1]["scored"]} == {str(t) for t in then}


def test_return_to_explain(spark, panel):
    df = panel.drop("ret").withColumns({"raw_close_open_derisked": panel["raw_close_open"] * 2, "SWF": (panel["SecuCode"] % 3).cast("string")})
    plain = {(r[0], r[1]): r[2] for r in return_to_explain(df, "raw_close_open").select("SecuCode", "TradingDay", "ret").collect()}
    twice = {(r[0], r[1]): r[2] for r in return_to_explain(df, "raw_close_open", derisk=True).select("SecuCode", "TradingDay", "ret").collect()}
    assert all((a is None) == (twice[k] is None) and (a is None or twice[k] == pytest.approx(2 * a)) for k, a in plain.items())
    neutral = return_to_explain(df, "raw_close_open", None, ind_neu=True)
    want = {(r[0], r[1]): r[2] for r in evaluate(df, {"v": "ind_neu(raw_close_open)"}).collect()}
    assert {(r[0], r[1]): r[2] for r in neutral.select("SecuCode", "TradingDay", "ret").collect()} == want and any(v is not None for v in want.values())
    assert {"close", "SWF", "raw_close_open"} <= set(neutral.columns)
    with pytest.raises(ValueError, match="no return"):
        return_to_explain(df, "nothing")
