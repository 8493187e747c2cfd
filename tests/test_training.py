import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression

from helpers import numpy_newton, vectors, weights
from logistra.operators import moments, scoring, vectors as V
from logistra.plans import features, newton
from logistra.plans.layout import Shape, measure
from logistra.sources import model

SMALL = [([1, 0.5], 0), ([1, 1], 1), ([1, 1.5], 0), ([1, 2], 1), ([1, 2.5], 0), ([1, 3], 1)]
STRATEGIES = ["wide", "blas", "long"]
FOLDER = "/root/testdata/sf0.001"


def random_rows(n, d, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, d - 1))])
    t = (rng.random(n) < 1 / (1 + np.exp(-x @ rng.normal(size=d)))).astype(float)
    return x, t


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_first_sums(spark, strategy):
    rows = vectors(spark, SMALL, 3)
    g = {r.i: r.g for r in moments.gradient(rows, [0, 0], strategy).collect()}
    assert g == {0: 0.0, 1: -0.75}
    h = {(r.i, r.j): r.h for r in moments.hessian(rows, [0, 0], strategy).collect()}
    assert h == {(0, 0): 1.5, (0, 1): 2.625, (1, 0): 2.625, (1, 1): 5.6875}


def test_fit_step_by_step(spark):
    got = newton.newton_train(vectors(spark, SMALL), 2, history=True).collect()
    want = {
        1: (-1.2000000000000002, 0.6857142857142857),
        2: (-1.264138865834379, 0.7223650661910739),
        3: (-1.2646226402976406, 0.7226415087415089),
        4: (-1.2646226683542765, 0.7226415247738723),
        6: (-1.2646226683542763, 0.7226415247738721),
    }
    for iteration, pair in want.items():
        w = [r.w for r in got if r.iteration == iteration]
        assert w == pytest.approx(pair, abs=1e-12)
    assert len(got) == 12 and not any(r.singular for r in got)


def test_one_feature(spark):
    rows = vectors(spark, [([1], 1), ([2], 0), ([-1], 1)])
    assert weights(newton.newton_train(rows, 1)) == pytest.approx([-0.7563076126159647])


def test_singular_keeps_weights(spark):
    rows = vectors(spark, [([1, 2], 0), ([2, 4], 1), ([3, 6], 1), ([1, 2], 0)])
    got = newton.newton_train(rows, 2, history=True).collect()
    assert all(r.w == 0.0 and r.singular for r in got) and len(got) == 12


def test_rounding_singular_keeps_weights(spark):
    rng = np.random.default_rng(5)
    rows = [([1.0, x, 0.1 * x + 0.3], x > 0) for x in rng.normal(size=50)]
    got = newton.newton_train(vectors(spark, rows), 3).collect()
    assert all(r.w == 0.0 and r.singular for r in got)


def test_badly_scaled_features_are_not_singular(spark):
    x, t = random_rows(200, 3, 8)
    scaled = x * [1, 1e9, 1e-9]
    got = weights(newton.newton_train(vectors(spark, zip(scaled, t)), 3))
    assert np.array(got) * [1, 1e9, 1e-9] == pytest.approx(numpy_newton(x, t), rel=1e-8)


def test_separable(spark):
    rows = vectors(spark, [([1, -2], 0), ([1, -1], 0), ([1, 1], 1), ([1, 2], 1)])
    got = newton.newton_train(rows, 2, history=True).collect()
    slopes = [r.w for r in got if r.i == 1]
    want = [1.2, 2.0237910883, 2.9093263912, 3.8564291461, 4.8353914109, 5.8274536895]
    assert slopes == pytest.approx(want, abs=1e-9)
    assert all(abs(r.w) < 1e-13 for r in got if r.i == 0)


def test_empty_table_keeps_weights(spark):
    rows = vectors(spark, SMALL).filter("false")
    got = newton.newton_train(rows, 2).collect()
    assert [(r.w, r.singular) for r in got] == [(0.0, True)] * 2
    assert all(r.g == 0.0 for r in moments.gradient(rows, [0.0, 0.0]).collect())


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_nan_row_adds_nothing(spark, strategy):
    clean = vectors(spark, SMALL)
    dirty = vectors(spark, [*SMALL, ([1, float("nan")], 1)])
    for w in ([0, 0], [0.3, -0.2]):
        for job in (moments.gradient, moments.hessian):
            want = sorted(map(tuple, job(clean, w, strategy).collect()))
            got = sorted(map(tuple, job(dirty, w, strategy).collect()))
            assert np.array(got) == pytest.approx(np.array(want), abs=1e-12)


def test_nan_row_cells(spark):
    dirty = vectors(spark, [([1, float("nan")], 1)])
    assert scoring.row_gradient(dirty, [0, 0]).first().grad == [4.9e-324] * 2
    assert scoring.row_gradient(dirty, [0, 0], "element").first().grad == [4.9e-324] * 2
    assert {r.h for r in scoring.row_hessian_coo(dirty, [0, 0]).collect()} == {4.9e-324}


def test_guard_of_residual_or_element(spark):
    """An exact hit on an infinite feature: 0 * inf, with a residual of 0."""
    rows = vectors(spark, [([1, float("inf")], 1)])
    by_residual = scoring.row_gradient(rows, [0, 1], "residual").first().grad
    assert by_residual[0] == 0.0 and np.isnan(by_residual[1])
    assert scoring.row_gradient(rows, [0, 1], "element").first().grad == [0.0, 4.9e-324]


def test_saturation(spark):
    rows = vectors(spark, [([1000], 1), ([-1000], 1)])
    got = scoring.score(rows, [1.0]).collect()
    assert [(r.margin, r.p, r.resid, r.curv) for r in got] == [
        (1000.0, 1.0, 0.0, 0.0),
        (-1000.0, 0.0, -1.0, 0.0),
    ]


def test_scalar_curvature(spark):
    assert scoring.row_curvature(vectors(spark, [([1, 2], 0)]), [0, 0]).first().h == 2.5


def test_dense_and_coo_row_hessians_agree(spark):
    rows = vectors(spark, SMALL)
    dense = scoring.row_hessian_dense(rows, [0.2, -0.1]).collect()
    coo = scoring.row_hessian_coo(rows, [0.2, -0.1], ["t"]).collect()
    flat = sorted(v for row in dense for line in row.hessian for v in line)
    assert flat == pytest.approx(sorted(r.h for r in coo))


def test_weights_as_column_and_as_list_agree(spark):
    rows = vectors(spark, SMALL)
    w = [0.3, -0.7]
    joined = scoring.with_weights(rows, newton.model_frame(spark, w))
    a = [r.margin for r in scoring.score(joined, "w").collect()]
    assert a == [r.margin for r in scoring.score(rows, w).collect()]


@pytest.mark.parametrize("bad", [([1], 0), ([1, 2, 3], 0), ([1, None], 0), ([1, 2], None)])
@pytest.mark.parametrize("strategy", ["wide", "blas"])
def test_bad_rows_fail(spark, bad, strategy):
    x, t = bad
    frame = spark.createDataFrame(
        [([None if v is None else float(v) for v in x], None if t is None else float(t))],
        "phi array<double>, t double",
    )
    with pytest.raises(Exception, match="null"):
        moments.gradient(frame, [0.0, 0.0], strategy).collect()


def test_score_checks_lengths(spark):
    rows = vectors(spark, SMALL)
    for w in ([1.0], [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="differ in length"):
            scoring.score(rows, w).collect()
    joined = scoring.with_weights(rows, newton.model_frame(spark, [1.0]))
    with pytest.raises(Exception, match="differ in length"):
        scoring.score(joined, "w").collect()


@pytest.mark.parametrize("d", [2, 8, 9, 20])
@pytest.mark.parametrize("strategy", ["wide", "blas"])
def test_training_matches_numpy(spark, d, strategy):
    x, t = random_rows(400, d, d)
    rows = vectors(spark, zip(x, t), 5)
    got = weights(newton.newton_train(rows, d, strategy=strategy))
    assert got == pytest.approx(numpy_newton(x, t), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("strategy", ["wide", "blas"])
def test_copies_collapse_without_changing_the_result(spark, strategy):
    rows = vectors(spark, SMALL * 50, 4)
    plain = weights(newton.newton_train(rows, 2, strategy=strategy, collapse="never"))
    for collapse in ("always", "auto"):
        got = weights(newton.newton_train(rows, 2, strategy=strategy, collapse=collapse))
        assert got == pytest.approx(plain, rel=1e-10)


def test_collapse_is_chosen_by_shape(spark):
    rows = vectors(spark, SMALL * 50, 4)
    shape = measure(rows, ["phi", "t"])
    assert shape == Shape(300, 6, 4) and shape.collapses()
    assert not Shape(rows=1000, distinct=300, tasks=1).collapses()
    assert not Shape(rows=1000, distinct=30, tasks=10).collapses()


@pytest.mark.parametrize("d", [2, 9])
def test_the_first_pass_measures(spark, monkeypatch, d):
    """Six steps are six passes: no pass of its own finds out whether equal rows pay."""
    from logistra.plans import layout

    plain = [(row + [float(i % 3)] * (d - 2), t) for i, (row, t) in enumerate(SMALL * 50)]
    rows = vectors(spark, plain, 4)
    want = weights(newton.newton_train(rows, d, collapse="never", tolerance=1e-6))

    def no_pass(*_):
        raise AssertionError("a pass to measure")

    monkeypatch.setattr(layout, "measure", no_pass)
    chosen, collapse = [], layout.collapse_copies
    monkeypatch.setattr(layout, "collapse_copies", lambda *a: chosen.append(1) or collapse(*a))
    assert weights(newton.newton_train(rows, d, tolerance=1e-6)) == pytest.approx(want, rel=1e-9)
    assert chosen == [1]


def test_tree_sum(spark):
    rows = moments.design(vectors(spark, SMALL, 5), 2)
    cells = moments.hessian_cells(2) + moments.gradient_cells(2)
    plain = moments.cell_sums(rows, 2, [0.1, 0.2], cells).first()
    tree = moments.cell_sums(rows, 2, [0.1, 0.2], cells, tree=True).first()
    assert list(tree) == pytest.approx(list(plain))


def test_resume(spark, tmp_path):
    rows = features.line(spark, FOLDER)
    model.save_model(newton.newton_train(rows, 3, iterations=3), str(tmp_path / "m"))
    stored = model.load_model(spark, str(tmp_path / "m"))
    resumed = weights(newton.newton_train(rows, 3, iterations=3, init=stored))
    assert resumed == pytest.approx(weights(newton.newton_train(rows, 3)), rel=1e-12)


def test_init_of_other_width_fails(spark):
    with pytest.raises(ValueError, match="1 weights for 2"):
        newton.newton_train(vectors(spark, SMALL), 2, init=newton.model_frame(spark, [1.0]))


def test_partitioning_does_not_matter(spark):
    rows = features.line(spark, FOLDER)
    one = weights(newton.newton_train(rows.coalesce(1), 3, collapse="never"))
    many = weights(newton.newton_train(rows.repartition(13), 3, collapse="never"))
    kept = weights(newton.newton_train(rows, 3, collapse="never", persist=True))
    assert one == pytest.approx(many, rel=1e-10)
    assert one == pytest.approx(kept, rel=1e-10)


def test_bins_add_up(spark):
    rows = features.line(spark, FOLDER)
    w = [-0.5, 0.1, 0.2]
    total = moments.bins_total(moments.gradient_binned(rows, w, "l_orderkey"))
    want = {r.i: r.g for r in moments.gradient(rows, w).collect()}
    assert {r.i: r.g for r in total.collect()} == pytest.approx(want)


def test_strategies_agree(spark):
    rows = features.line_wide(spark, FOLDER)
    w = [0.1, -0.2, 0.3, 0.2, -0.1]
    sums = [sorted(map(tuple, moments.hessian(rows, w, s).collect())) for s in STRATEGIES]
    assert np.array(sums[0]) == pytest.approx(np.array(sums[1]), rel=1e-9)
    assert np.array(sums[0]) == pytest.approx(np.array(sums[2]), rel=1e-9)


def test_limit_matches_generalized_linear_regression(spark):
    rows = features.line(spark, FOLDER).selectExpr("phi[1] AS a", "phi[2] AS b", "t")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows)
    fitted = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="x", labelCol="t", tol=1e-12
    ).fit(data)
    want = [fitted.intercept, *fitted.coefficients]
    got = weights(newton.newton_train(features.line(spark, FOLDER), 3))
    assert got == pytest.approx(want, abs=1e-8)


def test_step_reports_its_parts(spark):
    got = newton.newton_step(vectors(spark, SMALL), [0.0, 0.0]).collect()
    assert [r.g for r in got] == [0.0, -0.75]
    assert [r.w_new for r in got] == pytest.approx([-1.2, 0.6857142857142857])
    assert [r.w_old - r.update for r in got] == [r.w_new for r in got]


def test_indexed_vectors(spark):
    cells = spark.createDataFrame([(2, 0.3), (0, 0.1), (1, 0.2)], "i int, v double")
    assert V.indexed_to_dense(cells).first().phi == [0.1, 0.2, 0.3]
    assert V.indexed_to_dense(cells.filter("false")).count() == 0
    with pytest.raises(Exception, match="gap"):
        V.indexed_to_dense(cells.filter("i != 1")).collect()
    with pytest.raises(Exception, match="repeated"):
        V.indexed_to_dense(cells.union(cells)).collect()


def test_sums_and_sequences(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0])], "key string, phi array<double>"
    )
    assert sorted(map(tuple, V.vector_sum(rows, "key").collect())) == [
        ("a", 0, 4.0),
        ("a", 1, 6.0),
        ("b", 0, 5.0),
    ]
    ints = spark.createDataFrame([("a", 2**31 - 1), ("a", 1)], "key string, v int")
    assert V.sum_by_key(ints, "key", "v").first().total == 2**31


def test_vector_subtract(spark):
    a = spark.createDataFrame([(0, 3.0), (1, 1.0)], "i int, v double")
    b = spark.createDataFrame([(0, 1.0), (1, 1.5)], "i int, v double")
    assert sorted(map(tuple, V.vector_subtract(a, b).collect())) == [(0, 2.0), (1, -0.5)]
    for left, right in ((a, b.filter("i = 0")), (a.filter("i = 0"), b)):
        with pytest.raises(Exception, match="differ in length"):
            V.vector_subtract(left, right).collect()


def test_rowwise_jobs_take_a_stream(spark, tmp_path):
    from logistra.sources import text

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 0.5 0\n1 1.0 1\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    scored = scoring.score(text.parse_labelled(stream), [0.0, 1.0])
    query = scored.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.margin for r in spark.table("scored").collect()) == [0.5, 1.0]


@pytest.mark.parametrize("strategy", ["wide", "blas"])
@pytest.mark.parametrize("n", [None, float("nan"), -1.0])
def test_multiplicity_that_is_no_count_fails(spark, strategy, n):
    rows = spark.createDataFrame(
        [([1.0, 2.0], 1.0, 1.0), ([1.0, 3.0], 0.0, n)], "phi array<double>, t double, n double"
    )
    with pytest.raises(Exception, match="multiplicity"):
        moments.newton_system(rows, 2, [0.0, 0.0], strategy=strategy).collect()
