"""Exact sums against ``math.fsum``, which rounds once, and under other dealings of the rows."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from helpers import vectors
from logistra.operators import exact
from logistra.operators.moments import gradient, gradient_cells, hessian, hessian_cells, newton_system
from logistra.plans.newton import newton_train


def added(rows):
    """Digits of ``rows`` (lists of cells) through the same steps as in a task, and rounded."""
    values = np.array(rows, dtype=float)
    total = {}
    for half in (values[: len(values) // 2], values[len(values) // 2 :]):
        group = np.zeros(len(half), dtype=np.int64)
        parts = exact._digits([()], group, half, np.ones(half.shape, dtype=bool), np.array([half.shape[1]]))
        for keys, sums, _, _ in parts:
            for (digit,), row in zip(keys, sums):
                total[digit] = total.get(digit, 0) + row
    return [exact.nearest(list(total), [row[i] for row in total.values()]) for i in range(values.shape[1])]


finite = st.floats(allow_nan=False, allow_infinity=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(finite, min_size=1, max_size=30))
def test_nearest_double(cells):
    try:
        want = math.fsum(cells)
    except OverflowError:
        return  # fsum gives up where a partial sum overflows
    assert added([[c] for c in cells]) == [want]


def test_edges():
    big, small = 1.7976931348623157e308, 5e-324
    assert added([[big], [big], [-big]]) == [big]
    assert added([[big], [big]]) == [math.inf]
    assert added([[small], [small]]) == [1e-323]
    assert added([[1.0], [small], [-1.0]]) == [small]
    assert added([[2.0**53], [1.0], [1.0]]) == [2.0**53 + 2]
    assert added([[0.0], [-0.0]]) == [0.0]
    assert added([[-1.0], [2.0**-900]]) == [-1.0]
    assert math.isnan(added([[math.inf], [-math.inf]])[0])
    assert added([[math.inf], [1.0]]) == [math.inf]
    assert math.isnan(added([[math.nan], [1.0]])[0])


def rough(n=3000):
    rng = random.Random(3)
    return [
        (rng.choice(["a", "a", "a", "b", None]),
         None if i % 97 == 0 else [rng.gauss(0, 1) * 10 ** rng.randrange(-12, 12) if rng.random() < 0.95 else None
                                   for _ in range(rng.choice([3, 3, 3, 2, 0]))])
        for i in range(n)
    ]


def test_vector_sum_in_any_order(spark):
    rows = rough() + [("c", [None, 1.0])]
    want = {}
    for key, cells in rows:
        for i, v in enumerate(cells or []):
            want.setdefault((key, i), []).append(v)
    want = {k: math.fsum(v for v in vs if v is not None) if any(v is not None for v in vs) else None
            for k, vs in want.items()}
    frame = spark.createDataFrame(rows, "k string, phi array<double>")
    for parts in (1, 7, 200):
        found = exact.exact_vector_sum(frame.repartition(parts), "k").collect()
        assert {(r.k, r.i): r.v for r in found} == want
    assert exact.exact_vector_sum(frame.limit(0), "k").collect() == []
    with pytest.raises(ValueError):
        exact.exact_vector_sum(frame.selectExpr("1.5D AS k", "phi"), "k")


def test_training_has_one_result(spark):
    rng = random.Random(4)
    rows = [([1.0, rng.gauss(0, 1), rng.gauss(0, 30)], rng.random() < 0.4) for _ in range(2000)]
    frame = vectors(spark, rows)
    runs, plain = [], newton_train(frame, 3, 2).collect()
    for parts in (1, 7, 200):
        model = newton_train(frame.repartition(parts), 3, 2, strategy="exact").collect()
        runs.append([r.w for r in sorted(model, key=lambda r: r.i)])
    assert runs[0] == runs[1] == runs[2]
    assert runs[0] == pytest.approx([r.w for r in sorted(plain, key=lambda r: r.i)], rel=1e-9)
    assert newton_train(frame.limit(0), 3, strategy="exact").filter("singular").count() == 3


@pytest.mark.parametrize("d", [3, 12])
def test_system_as_by_the_other_strategies(spark, d):
    rng = random.Random(5)
    rows = [([rng.gauss(0, 1) for _ in range(d)], rng.random() < 0.4) for _ in range(500)]
    rows += [([math.nan] * d, 1), ([math.inf] + [1.0] * (d - 1), 1)]
    frame, w = vectors(spark, rows, 5).selectExpr("*", "1 + CAST(t AS int) AS n"), [0.1] * d
    both = hessian_cells(d) + gradient_cells(d)
    got = {(r.i, r.j): r.v for r in newton_system(frame, d, w, both, "exact").collect()}
    want = {(r.i, r.j): r.v for r in newton_system(frame, d, w, both, "blas").collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True)
    assert len(gradient(frame, w, "exact").collect()) == d
    assert len(hessian(frame, w, "exact").collect()) == d * d
