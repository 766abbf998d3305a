import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorweave.operators.registry import OPERATORS, register_operator
from factorweave.plans import ast
from factorweave.plans.compiler import schedule


def test_all_operators_are_there():
    assert len([o for o in OPERATORS.values() if o.name.startswith(("ts_", "cs_", "ind_", "comb_"))]) == 35


@pytest.mark.parametrize(("text", "printed"), [
    ("ts_mean(raw_close_close,20)", "ts_mean(raw_close_close,20)"), (" comb_div( open , close ) ", "comb_div(open,close)"),
    ("ts_shift(close,20)", "ts_shift(close,6)"), ("ts_shift(close,7)", "ts_shift(close,1)"), ("ts_autocorr(close,5)", "ts_autocorr(close,15)"),
    ("ts_rms(close,4)", "ts_rms(close,9)"), ("cs_rank(ts_corr_20D(close,TurnoverVolume))", "cs_rank(ts_corr_20D(close,TurnoverVolume))"),
])
def test_parse_prints_what_is_computed(text, printed):
    assert str(ast.parse(text)) == printed
    assert ast.parse(printed) == ast.parse(text)


@pytest.mark.parametrize("text", ["", "nope(close)", "ts_mean(close)", "cs_rank(close,3)", "comb_add(close)", "ts_mean(close,0)", "ts_mean(close,5", "ts_mean(close,5))", "3", "ts_mean(3,close)", "close close", "a-b"])
def test_what_cannot_be_read_says_so(text):
    with pytest.raises(ast.ExpressionError):
        ast.parse(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4))
def test_random_trees(seed, depth):
    rng = random.Random(seed)
    a, b = ast.draw(rng, depth, stop=0.2), ast.draw(rng, depth)
    assert ast.parse(str(a)) == a
    assert a.depth <= depth and b.depth == depth
    assert ast.prune(b, depth - 1, rng).depth <= depth - 1
    before = str(a), str(b)
    x, y = ast.crossover(a, b, rng)
    assert ast.parse(str(ast.mutate(x, rng))).op is not None or x.op is not None
    assert (str(a), str(b)) == before
    for t in (a, x, y):
        assert ast.infer_type(t) in {"price", "ticker_float", "pct_change", "uniform", "norm", "float"}


def test_types():
    assert ast.infer_type(ast.parse("comb_add(close,open)")) == "price"
    assert ast.infer_type(ast.parse("comb_add(cs_rank(close),cs_norm(close))")) == "norm"
    assert ast.infer_type(ast.parse("comb_add(close,raw_close_close)")) == "ticker_float"
    assert ast.infer_type(ast.parse("ts_diff(TurnoverValue,3)")) == "ticker_float"


def test_equal_subtrees_are_scheduled_once():
    trees = [ast.parse(e) for e in ("cs_rank(ts_mean(close,5))", "comb_sub(ts_mean(close,5),ts_std(close,5))", "ts_max(cs_rank(ts_mean(close,5)),3)")]
    rounds = schedule(trees)
    names = [str(x) for r in rounds for x in r]
    assert len(names) == len(set(names)) == 5
    assert {str(x) for x in rounds[0]} == {"ts_mean(close,5)", "ts_std(close,5)"}


def test_a_name_can_be_taken_once():
    with pytest.raises(ValueError):
        register_operator("ts_mean", "ts", lambda x, n: ({}, lambda: x))
