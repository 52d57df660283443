"""Pivotal rounding: totals hit their targets, expectations are kept, runs repeat."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from folio.llm import pivotal_mix as pm


def docs(spark, sizes, extra=()):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, "t", source, 9))
            i += 1
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, source string, copies int")


def test_default_keeps_every_document(spark):
    sizes = {"big": 200, "mid": 60, "small": 7, None: 1}
    rows = pm.copies(docs(spark, sizes)).collect()
    total = Counter()
    for r in rows:
        total[r.source] += r.copies
    assert len(rows) == sum(sizes.values()) and min(r.copies for r in rows) >= 1 and total["big"] == 200
    for s, n in sizes.items():
        assert abs(total[s] - n * (n / 200) ** -0.3) < 1


@pytest.mark.parametrize("total", [40, 137.5, 900])
def test_given_weights(spark, total):
    sizes = {"a": 120, "b": 45, "c": 30, "unused": 10}
    weights = {"a": 1.0, "b": 2.0, "c": 1.0, "absent": 0.0}
    n, by = Counter(), {}
    for r in pm.copies(docs(spark, sizes), weights, total=total).collect():
        n[r.source] += r.copies
        by.setdefault(r.source, set()).add(r.copies)
    assert n["unused"] == 0
    for s, w in (("a", 1), ("b", 2), ("c", 1)):
        target = total * w / 4
        assert abs(n[s] - target) < 1
        assert by[s] <= {int(target / sizes[s]), int(target / sizes[s]) + 1}


def test_runs_repeat_and_seeds_differ(spark):
    df = docs(spark, {"a": 150, "b": 20})
    one, two, other = (sorted(map(tuple, pm.copies(x, {"a": 1, "b": 1}, total=50, seed=s).collect())) for x, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert one == two != other


def test_rounding_keeps_expectations():
    p = np.array([0.1, 0.5, 0.5, 0.9, 0.3, 0.7, 0.25, 0.75, 0.0, 1.0])
    rng = np.random.default_rng(0)
    seen = np.zeros(len(p))
    for _ in range(4000):
        out, held = pm.pivotal(p, rng.random(len(p)))
        assert held < 0 and set(out) <= {0.0, 1.0} and out.sum() == 5
        seen += out
    assert np.abs(seen / 4000 - p).max() < 0.03
    out, held = pm.pivotal(np.array([0.3, 0.4]), np.array([0.5, 0.5]))
    assert held >= 0 and abs(out.sum() - 0.7) < 1e-12


def outcomes(p):
    """All results of rounding in pairs with their chances, in exact fractions: places of 0, 1 and at most one open."""
    states = {(tuple(p), -1): Fraction(1)}
    for i in range(len(p)):
        new = {}
        for (x, held), chance in states.items():
            if x[i] in (0, 1) or held < 0:
                branches = [(x, held if x[i] in (0, 1) else i, Fraction(1))]
            else:
                a, b = x[held], x[i]
                low, high = ((Fraction(0), a + b)) if a + b <= 1 else (a + b - 1, Fraction(1))
                # mass moves so that each keeps its expectation: the first ends low with the chance that solves it
                first_high = (a - low) / (high - low)
                branches = []
                for part, (u, v) in ((first_high, (high, low)), (1 - first_high, (low, high))):
                    y = list(x)
                    y[held], y[i] = u, v
                    open_ = [k for k in (held, i) if y[k] not in (0, 1)]
                    branches.append((tuple(y), open_[0] if open_ else -1, part))
            for y, h, part in branches:
                if part:
                    new[y, h] = new.get((y, h), 0) + chance * part
        states = new
    return states


@pytest.mark.parametrize("p", [["1/4", "1/2", "3/4"], ["1/3", "1/3", "1/3", "1/2"], ["9/10", "4/5", "1/10", "0", "7/10"], ["1/2", "1"]])
def test_rounding_against_all_outcomes(p):
    p = [Fraction(x) for x in p]
    want = outcomes(p)
    for i, x in enumerate(p):
        assert sum(s[0][i] * chance for s, chance in want.items()) == x
    rng, seen, n = np.random.default_rng(7), Counter(), 6000
    for _ in range(n):
        out, held = pm.pivotal(np.array([float(x) for x in p]), rng.random(len(p)))
        key = (tuple(Fraction(float(x)).limit_denominator(1000) for x in out), held)
        assert key in want
        seen[key] += 1
    assert all(abs(seen[k] / n - float(chance)) < 0.03 for k, chance in want.items())


def test_edges(spark):
    extra = [(0, "t", "a", 9), (None, "n", "a", 9), (500, None, None, 9), (501, "", None, 9)]
    df = docs(spark, {"a": 20, "b": 2}, extra)
    rows = pm.copies(df).collect()
    assert len(rows) == 24 and None not in {r.doc_id for r in rows}
    n = Counter(r.doc_id for r in rows for _ in range(r.copies))
    mixed = pm.mixed(df)
    assert mixed.columns == df.columns
    out = Counter(r.doc_id for r in mixed.collect())
    assert out[None] == 1 and out[0] == 2 * n[0] and all(out[k] == v for k, v in n.items() if k)
    empty = spark.createDataFrame([], df.schema)
    assert pm.copies(empty).count() == 0 and pm.mixed(empty).count() == 0
