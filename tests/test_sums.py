import numpy as np
import pyarrow as pa
import pytest

from helpers import numpy_newton
from logistra.operators import moments, sums, vectors
from logistra.plans import keyed
from pyspark.sql import functions as F


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def expected(rows):
    """{(key, i): sum} as an exploding aggregate gives it; None where all cells are null."""
    out = {}
    for key, phi in rows:
        for i, v in enumerate(phi or []):
            old = out.get((key, i))
            out[key, i] = old if v is None else v if old is None else old + v
    return out


def ragged(n=500, seed=3):
    rng = np.random.default_rng(seed)
    keys = ["a", "b", None, "a longer key", ""]
    rows = []
    for _ in range(n):
        cells = rng.integers(-9, 10, rng.integers(0, 12)).astype(float).tolist()
        cells = [None if rng.random() < 0.2 else v for v in cells]
        rows.append((keys[rng.integers(0, 5)], cells if rng.random() < 0.9 else None))
    # A third of the rows has one key; a key has only nulls; one has no cells.
    return rows + [("hot", [1.0, 2.0])] * (n // 2) + [("nulls", [None, None]), ("none", [])]


@pytest.mark.parametrize("budget, cells", [(1 << 26, 1024), (64, 1024), (1 << 26, 3), (1, 2)])
@pytest.mark.parametrize("tree", [False, True])
def test_sums_of_ragged_arrays(spark, monkeypatch, budget, cells, tree):
    monkeypatch.setattr(sums, "PART_CELLS", cells)
    rows = ragged()
    frame = spark.createDataFrame(rows, "key string, v array<double>").repartition(7)
    out = sums.Out(None, ["i", "v"])
    found = sums.array_sums(frame, ["key"], "v", tree=tree, out=out, budget=budget)
    got = {(r.key, r.i): r.v for r in found.collect()}
    assert got == expected(rows)
    assert found.count() == len(got)


def test_whole_arrays_put_parts_together(spark, monkeypatch):
    monkeypatch.setattr(sums, "PART_CELLS", 4)
    rows = [(k, [float(k * 100 + i) for i in range(11)]) for k in range(5)] * 3
    frame = spark.createDataFrame(rows, "key int, v array<double>").repartition(3)
    whole = sums.whole_arrays(sums.array_sums(frame, ["key"], "v"), ["key"], 11)
    assert {r.key: r[sums.CELLS] for r in whole.collect()} == {
        k: [3 * x for x in v] for k, v in rows[:5]
    }


def test_vector_sum_sends_arrays(spark):
    rows = [(i % 3, [float(i), 1.0, -2.0]) for i in range(100)]
    frame = spark.createDataFrame(rows, "key int, phi array<double>")
    found = vectors.vector_sum(frame, "key")
    assert "Generate" not in plan(found)
    assert {(r.key, r.i): r.v for r in found.collect()} == expected(rows)
    assert vectors.vector_sum(frame.where("false"), "key").collect() == []
    # Doubles as keys: -0.0 is 0.0 and NaN is one key.
    odd = spark.createDataFrame(
        [(0.0, [1.0]), (-0.0, [2.0]), (float("nan"), [4.0]), (float("nan"), [8.0])],
        "key double, phi array<float>",
    )
    assert sorted(r.v for r in vectors.vector_sum(odd, "key").collect()) == [3.0, 12.0]


def test_sums_of_several_keys_of_many_types(spark):
    frame = spark.sql(
        """SELECT id % 3 AS a, CAST(id % 2 AS boolean) AS b, DATE'2020-01-01' + CAST(id % 2 AS int) AS c,
        CAST(id % 2 AS decimal(10, 2)) AS d, CAST(CAST(id % 3 AS string) AS binary) AS e,
        array(CAST(id AS double), 1D) AS phi FROM range(60)"""
    )
    keys = list("abcde")
    found = vectors.vector_sum(frame, keys)
    cells = frame.select(*keys, F.posexplode("phi").alias("i", "v"))
    want = cells.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def wide_rows(spark, n=4000, d=12, keys=40, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, d - 1))])
    t = (rng.random(n) < 1 / (1 + np.exp(-x @ rng.normal(size=d) * 0.3))).astype(float)
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(0, keys, n))
    data = list(zip(key.tolist(), x.tolist(), t.tolist()))
    frame = spark.createDataFrame(data, "key int, phi array<double>, t double").repartition(16)
    return frame, key, x, t


def test_keyed_training_past_eight_features_moves_no_rows(spark, monkeypatch):
    """While the weights are broadcast, rows are read where they are: below the sums is no exchange."""
    frame, key, x, t = wide_rows(spark, n=8000, keys=20)
    plans, laid_out, whole = [], [], keyed._Rows.stacked_systems

    def noted(self, state):
        systems = whole(self, state)
        plans.append(plan(systems))
        laid_out.append(self.laid_out)
        return systems

    monkeypatch.setattr(keyed._Rows, "stacked_systems", noted)
    found = keyed.newton_train_by(frame, "key", 12, iterations=3, collapse="never").collect()
    assert laid_out == [False] * 3
    for text in plans:
        lines = text.splitlines()
        python = max(n for n, line in enumerate(lines) if "MapInArrow" in line)
        below = [line for line in lines[python + 1 :] if "Exchange hash" in line]
        assert not below, text
    got = {}
    for r in found:
        got.setdefault(r.key, {})[r.i] = r.w
    for k in np.unique(key):
        mine = key == k
        want = numpy_newton(x[mine], t[mine], steps=3)
        assert [got[k][i] for i in range(12)] == pytest.approx(want.tolist(), rel=1e-7)


def test_many_keys_with_few_rows_are_laid_out(spark, monkeypatch):
    frame, *_ = wide_rows(spark, n=600, d=9, keys=400)
    laid_out, whole = [], keyed._Rows.stacked_systems

    def noted(self, state):
        systems = whole(self, state)
        laid_out.append(self.laid_out)
        return systems

    monkeypatch.setattr(keyed._Rows, "stacked_systems", noted)
    keyed.newton_train_by(frame, "key", 9, iterations=1, collapse="never").collect()
    assert laid_out == [True]


def test_small_budgets_and_parts_change_no_system(spark, monkeypatch):
    frame, key, x, t = wide_rows(spark, n=900, keys=7)
    w = np.linspace(-0.2, 0.2, 12).tolist()
    want = {(r.key, r.i, r.j): r.v for r in moments.hessian_by(frame, "key", w).collect()}
    monkeypatch.setattr(sums, "PART_CELLS", 5)
    monkeypatch.setattr(moments, "SLICE_BYTES", 1)
    got = {(r.key, r.i, r.j): r.v for r in moments.hessian_by(frame, "key", w).collect()}
    assert got.keys() == want.keys() and len(got) == 7 * 144
    for place, v in want.items():
        assert got[place] == pytest.approx(v, rel=1e-12, abs=1e-12)
    whole = {(r.i, r.j): r.h for r in moments.hessian(frame, w).collect()}
    for i, j in whole:
        assert whole[i, j] == pytest.approx(sum(want[k, i, j] for k in range(7)), rel=1e-9, abs=1e-9)


def test_batches_are_put_together_before_they_are_grouped():
    batches = [pa.RecordBatch.from_pydict({"k": [1, None, 2], "v": [[1.0], [2.0], [4.0]]}) for _ in range(5)]
    seen = []

    def source(batch):
        seen.append(batch.num_rows)
        yield from sums._arrays(batch, ["k"], "v")

    for gather, calls in ((10**6, [15]), (2 * batches[0].nbytes, [6, 6, 3]), (0, [3] * 5)):
        seen.clear()
        (out,) = sums._partial_sums(["k"], source, 10**6, gather)(iter(batches))
        assert seen == calls
        assert dict(zip(out["k"].to_pylist(), out["_cells"].to_pylist())) == {1: [5.0], None: [10.0], 2: [20.0]}
