"""Exact quantiles and moments by both paths, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from plumbline.functions.stats import with_shape
from plumbline.plans import orderstats

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


def data(kind, n=4000):
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(50, 10, n),
        "heavy": rng.pareto(1.1, n) * 100,
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 3, n)),
        "two": (rng.random(n) < 0.3).astype(float),
        "constant": np.full(n, 3.25),
        "negative": -rng.exponential(5, n),
        "tiny": np.array([2.0]),
    }[kind]


KINDS = ("normal", "heavy", "hot", "two", "constant", "negative", "tiny")


def check(column, values, moments=True):
    df = column(list(map(float, values)))
    row = orderstats.order_statistics(df, [(0, "x")], PROBS, moments).collect()[0]
    got = [row[f"q{i}"] for i in range(len(PROBS))]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12)
    assert row["n"] == len(values)


@pytest.mark.parametrize("kind", KINDS)
def test_small_table(column, kind):
    check(column, data(kind))


@pytest.mark.parametrize("kind", KINDS)
def test_brackets(column, monkeypatch, kind):
    monkeypatch.setattr(orderstats, "SKETCH_K", 64)
    check(column, data(kind))


@pytest.mark.parametrize("kind", ("heavy", "hot"))
def test_narrowing_and_misses(column, monkeypatch, kind):
    """Brackets that miss their rank or hold too much still end exact."""
    monkeypatch.setattr(orderstats, "SKETCH_K", 8)
    monkeypatch.setattr(orderstats, "BRACKET_ROWS", 30)
    monkeypatch.setattr(orderstats, "WIDTH", 0.02)
    check(column, data(kind), moments=False)


@pytest.mark.parametrize("kind", KINDS)
def test_moments_match_pandas(column, kind):
    values = pd.Series(data(kind))
    df = column(list(map(float, values)))
    stats = orderstats.order_statistics(df, [(0, "x")], (0.5,), True)
    row = with_shape(stats).collect()[0]
    assert row["mean"] == pytest.approx(values.mean(), rel=1e-12)
    for name, want in (("std", values.std()), ("skew", values.skew()), ("kurtosis", values.kurt())):
        if np.isnan(want):
            assert row[name] is None
        else:
            assert row[name] == pytest.approx(want, rel=1e-8, abs=1e-9), name
    assert (row["min"], row["max"]) == (values.min(), values.max())


def test_large_offset_keeps_precision(column, monkeypatch):
    values = pd.Series(1e9 + np.random.default_rng(1).normal(0, 1, 2000))
    stats = orderstats.order_statistics(column(list(map(float, values))), [(0, "x")], (0.5,), True)
    row = with_shape(stats).collect()[0]
    assert row["std"] == pytest.approx(values.std(), rel=1e-6)


def test_result_does_not_depend_on_partitioning(column, monkeypatch):
    monkeypatch.setattr(orderstats, "SKETCH_K", 40)
    values = list(map(float, data("heavy")))
    found = [
        orderstats.quantiles(column(values, parts=p), [(0, "x")], PROBS) for p in (1, 7)
    ]
    assert found[0] == found[1]


def test_sparse_column(column, monkeypatch):
    monkeypatch.setattr(orderstats, "SKETCH_K", 8)
    df = column([None] * 5000 + [1.0, 2.0, 4.0])
    assert orderstats.quantiles(df, [(0, "x")], (0.5,)) == {0: [2.0]}
