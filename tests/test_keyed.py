import numpy as np
import pytest

from helpers import numpy_newton
from logistra.operators import moments, sums
from logistra.plans import keyed
from pyspark.sql import functions as F

HOT = 1200


def keyed_rows(spark, d, seed=1, keys=6):
    """One key holds far more rows than the others together."""
    rng = np.random.default_rng(seed)
    data, want = [], {}
    for k in range(keys):
        n = HOT if k == 0 else 60
        x = np.column_stack([np.ones(n), rng.normal(size=(n, d - 1))])
        t = (rng.random(n) < 1 / (1 + np.exp(-0.5 * x @ rng.normal(size=d)))).astype(float)
        data += [(f"k{k}", k % 2, row.tolist(), float(label)) for row, label in zip(x, t)]
        want[(f"k{k}", k % 2)] = numpy_newton(x, t)
    frame = spark.createDataFrame(data, "name string, part int, phi array<double>, t double")
    return frame.repartition(6), want


def models(frame, keys=("name", "part")):
    out = {}
    for row in frame.collect():
        out.setdefault(tuple(row[k] for k in keys), {})[row.i] = row.w
    return {k: [w[i] for i in range(len(w))] for k, w in out.items()}


LAYOUTS = {
    "broadcast": {},
    "salted": {"broadcast_limit": 0, "rows_per_salt": 100},
    "collapsed": {"collapse": "always"},
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("strategy, d", [("wide", 1), ("wide", 3), ("wide", 8), ("blas", 3), ("blas", 10)])
def test_every_layout_matches_numpy(spark, monkeypatch, layout, strategy, d):
    monkeypatch.setattr(keyed, "strategy_for", lambda d: strategy)
    rows, want = keyed_rows(spark, d)
    got = models(keyed.newton_train_by(rows, ["name", "part"], d, **LAYOUTS[layout]))
    assert set(got) == set(want)
    for key, w in want.items():
        assert got[key] == pytest.approx(w, rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("strategy", ["wide", "blas"])
def test_singular_keys_keep_their_weights(spark, monkeypatch, strategy):
    monkeypatch.setattr(keyed, "strategy_for", lambda d: strategy)
    rows = spark.createDataFrame(
        [("flat", [1.0, 2.0], 0.0), ("flat", [2.0, 4.0], 1.0), ("flat", [3.0, 6.0], 1.0)]
        + [("one", [1.0, 0.7], 1.0)]
        + [("good", [1.0, x], t) for x, t in [(0.5, 0.0), (1.0, 1.0), (1.5, 0.0), (2.0, 1.0)]],
        "key string, phi array<double>, t double",
    )
    got = keyed.newton_train_by(rows, "key", 2).collect()
    assert all(r.w == 0.0 and r.singular for r in got if r.key in ("flat", "one"))
    good = [r for r in got if r.key == "good"]
    x = np.array([[1, 0.5], [1, 1.0], [1, 1.5], [1, 2.0]])
    assert [r.w for r in sorted(good, key=lambda r: r.i)] == pytest.approx(
        numpy_newton(x, np.array([0.0, 1, 0, 1])), rel=1e-7
    )
    assert not any(r.singular for r in good)


@pytest.mark.parametrize("layout", ["broadcast", "salted"])
def test_history_and_resume(spark, layout):
    rows, want = keyed_rows(spark, 3)
    options = LAYOUTS[layout]
    steps = keyed.newton_train_by(rows, ["name", "part"], 3, history=True, **options)
    assert {r.iteration for r in steps.collect()} == {1, 2, 3, 4, 5, 6}
    third = steps.filter("iteration = 3").drop("iteration", "singular")
    resumed = models(keyed.newton_train_by(rows, ["name", "part"], 3, 3, init=third, **options))
    for key, w in want.items():
        assert resumed[key] == pytest.approx(w, rel=1e-9)
    # A key without a stored model starts from 0.
    partial = third.filter("name != 'k0'")
    mixed = models(keyed.newton_train_by(rows, ["name", "part"], 3, 3, init=partial, **options))
    assert mixed[("k0", 0)] == pytest.approx(models(third)[("k0", 0)], rel=1e-9)
    assert mixed[("k1", 1)] == pytest.approx(want[("k1", 1)], rel=1e-9)


def test_incomplete_init_fails(spark):
    rows, _ = keyed_rows(spark, 3)
    bad = spark.createDataFrame([("k0", 0, 0, 1.0)], "name string, part int, i int, w double")
    with pytest.raises(Exception, match="exactly 3"):
        keyed.newton_train_by(rows, ["name", "part"], 3, init=bad)


def test_null_keys_and_clashing_names_fail(spark):
    rows = spark.createDataFrame([(None, [1.0], 1.0)], "key string, phi array<double>, t double")
    with pytest.raises(Exception, match="null"):
        keyed.newton_train_by(rows, "key", 1).collect()
    with pytest.raises(ValueError, match="rename"):
        keyed.newton_train_by(rows.withColumnRenamed("key", "x0"), "x0", 1)


def test_hot_key_is_split_and_rows_stay_put(spark):
    rows, _ = keyed_rows(spark, 3)
    data = keyed._Rows(rows, ["name", "part"], 3, "never", False, 0, 100)
    zeros = [f"0D AS w{i}" for i in range(3)]
    state = rows.select("name", "part").distinct().selectExpr("*", *zeros)
    data.choose_join(state)
    plan = data.systems(state)._jdf.queryExecution().executedPlan().toString()
    salts = data.stored.rows.groupBy("name", keyed.SALT).count().collect()
    hot = [r["count"] for r in salts if r.name == "k0"]
    assert len(hot) > 3 and sum(hot) == HOT
    assert len([r for r in salts if r.name != "k0"]) == 5
    scan = plan[: plan.index("InMemoryTableScan")]
    join = scan[scan.index("SortMergeJoin") :]
    assert "Exchange" not in join and "Sort [" not in join
    data.close()


def test_sums_start_before_the_shuffle(spark):
    rows, _ = keyed_rows(spark, 3)
    sums = moments.hessian_by(rows, ["name"], [0.0, 0.0, 0.0])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan


def small_rows(spark, d, key, damaged=False):
    random = np.random.default_rng(3)
    rows = []
    for k in ("a", "b"):
        for n in range(60):
            x = [1.0, *random.normal(size=d - 1).tolist()]
            if damaged and k == "a" and n == 7:
                x[1] = float("nan")
            rows.append((k, x, float(random.random() < 0.5)))
    return spark.createDataFrame(rows, f"{key} string, phi array<double>, t double")


@pytest.mark.parametrize("d", [3, 9])
def test_nan_row_costs_only_itself(spark, d):
    trained = keyed.newton_train_by(small_rows(spark, d, "key", damaged=True), "key", d)
    clean = small_rows(spark, d, "key", damaged=True).where("NOT exists(phi, x -> isnan(x))")
    expected = {(r.key, r.i): r.w for r in keyed.newton_train_by(clean, "key", d).collect()}
    found = {(r.key, r.i): r.w for r in trained.collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-8 for k in expected)


@pytest.mark.parametrize("d", [3, 9])
@pytest.mark.parametrize("key", ["p", "size", "margin", "place", "cells", "salts"])
def test_key_names_do_not_clash(spark, d, key):
    trained = keyed.newton_train_by(small_rows(spark, d, key), key, d, iterations=2)
    assert trained.columns == [key, "i", "w", "singular"]
    assert trained.count() == 2 * d


def test_partials_are_summed_before_the_exchange(spark, monkeypatch):
    """A task sends one row per key, however many batches it reads."""
    rows = small_rows(spark, 9, "key").repartition(3)
    read = rows.groupBy(F.spark_partition_id(), "key").count().count()
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    monkeypatch.setattr(sums, "_merged", lambda partial, *_: partial)
    spark.conf.set(limit, 2)
    try:
        sent = moments.keyed_arrays(
            rows.selectExpr("key", "phi", "t", "1D AS n", "0D AS margin"), ["key"], 9, moments.hessian_cells(9)
        )
        assert sent.count() == read < rows.count()
    finally:
        spark.conf.set(limit, before)


def test_many_keys_are_laid_out_once(spark):
    rows = spark.range(6000).selectExpr(
        "id DIV 3 AS part", "array(1D, CAST(id % 3 AS double), rand(7)) AS phi",
        "CAST(id % 2 AS double) AS t",
    )
    data = keyed._Rows(rows.repartition(6), ["part"], 3, "never", False, 1 << 28, 4_000_000)
    state = rows.select("part").distinct().selectExpr("*", *[f"0D AS w{i}" for i in range(3)])
    data.choose_join(state)
    assert data.laid_out and data.fits and not data.salted
    plan = data.systems(state)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("InMemoryTableScan")]
    assert "Exchange hashpartitioning" not in above
    data.close()


def test_rows_are_laid_out_where_a_task_reads_more_keys_than_its_sums_hold(spark, monkeypatch):
    # 40 keys in each of two tasks, 65 cells of 9 bytes: 23,400 bytes a task.
    rows = spark.range(0, 4000, 1, 2).selectExpr(
        "id % 40 AS k", "transform(sequence(0, 9), i -> double(id % (i + 2))) AS phi", "double(id % 2) AS t"
    )
    for budget, laid_out in ((10_000, True), (1 << 20, False)):
        monkeypatch.setattr(keyed, "RUNNING_BYTES", budget)
        data = keyed._Rows(rows, ["k"], 10, "auto", False, 1 << 28, 1 << 20)
        assert data.stacked_systems(None).count() == 40
        assert data.laid_out == laid_out
        data.close()
