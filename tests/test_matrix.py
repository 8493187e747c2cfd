import numpy as np
import pytest

from helpers import coo, to_numpy
from logistra.functions import dense
from logistra.operators import matrix

TWO = {"a": [[2, 1], [1, 3]], "swap": [[0, 1], [1, 0]], "singular": [[1, 2], [2, 4]]}
THREE = {
    "swap": [[0, 2, 1], [1, 0, 3], [4, 1, 0]],
    "spd": [[4, 2, 1], [2, 5, 3], [1, 3, 6]],
}
ADJUGATE = {
    "a": [[3, -1], [-1, 2]],
    "swap": [[0, -1], [-1, 0]],
    "singular": [[4, -2], [-2, 1]],
}
ADJUGATE_3 = {
    "swap": [[-3, 1, 6], [12, -4, 1], [1, 8, -2]],
    "spd": [[21, -9, 1], [-9, 23, -10], [1, -10, 16]],
}


def close(got, want):
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(np.array(want[key], dtype=float), abs=1e-12)


def test_upper_triangle(spark):
    frame = matrix.upper_triangle(coo(spark, TWO).filter("key != 'singular'"), 2, "key")
    close(to_numpy(frame, 2), {"a": [[2, 1], [0, 2.5]], "swap": [[1, 0], [0, 1]]})
    assert {(r.key, r.sign) for r in frame.collect()} == {("a", 1), ("swap", -1)}
    frame = matrix.upper_triangle(coo(spark, THREE), 3, "key")
    want = {
        "swap": [[1, 0, 3], [0, 2, 1], [0, 0, -12.5]],
        "spd": [[4, 2, 1], [0, 4, 2.5], [0, 0, 4.1875]],
    }
    close(to_numpy(frame, 3), want)
    assert {(r.key, r.sign) for r in frame.collect()} == {("swap", -1), ("spd", 1)}


def test_pivot_row_two_below_moves_up_past_the_others(spark):
    frame = matrix.upper_triangle(coo(spark, {"k": [[0, 1, 2], [0, 3, 4], [5, 6, 7]]}), 3, "key")
    close(to_numpy(frame, 3), {"k": [[5, 6, 7], [0, 1, 2], [0, 0, -2]]})
    assert {r.sign for r in frame.collect()} == {1}


def test_determinant(spark):
    got = {r.key: r.det for r in matrix.determinant(coo(spark, TWO), 2, "key").collect()}
    assert got == pytest.approx({"a": 5, "swap": -1, "singular": 0})
    got = {r.key: r for r in matrix.determinant(coo(spark, THREE), 3, "key").collect()}
    assert {k: r.det for k, r in got.items()} == pytest.approx({"swap": 25, "spd": 67})
    assert got["spd"].log_abs_det == pytest.approx(np.log(67)) and got["spd"].sign == 1
    one = matrix.determinant(coo(spark, {"k": [[5]]}), 1, "key").first()
    assert one.det == 5.0


def test_determinant_past_the_largest_double(spark):
    row = matrix.determinant(coo(spark, {"k": np.diag([1e200, 1e200, 1, 1])}), 4, "key").first()
    assert row.det == float("inf") and row.log_abs_det == pytest.approx(400 * np.log(10))


def test_adjugate(spark):
    close(to_numpy(matrix.adjugate(coo(spark, TWO), 2, "key"), 2), ADJUGATE)
    close(to_numpy(matrix.adjugate(coo(spark, THREE), 3, "key"), 3), ADJUGATE_3)
    close(to_numpy(matrix.adjugate(coo(spark, {"k": [[5]]}), 1, "key"), 1), {"k": [[1]]})


def test_inverse(spark):
    frame = matrix.inverse(coo(spark, TWO), 2, "key")
    want = {"a": [[0.6, -0.2], [-0.2, 0.4]], "swap": [[0, 1], [1, 0]]}
    want["singular"] = [[0, 0], [0, 0]]
    close(to_numpy(frame, 2), want)
    assert {r.key for r in frame.collect() if r.singular} == {"singular"}
    got = to_numpy(matrix.inverse(coo(spark, THREE), 3, "key"), 3)
    close(got, {k: np.linalg.inv(np.array(m, dtype=float)) for k, m in THREE.items()})


@pytest.mark.parametrize("d", [4, 7])
def test_wide_matrices(spark, d):
    rng = np.random.default_rng(d)
    matrices = {str(k): rng.normal(size=(d, d)) for k in range(20)}
    matrices["rank"] = np.outer(np.arange(1.0, d + 1), np.ones(d))
    frame = coo(spark, matrices)
    regular = {k: m for k, m in matrices.items() if k != "rank"}
    inverse = matrix.inverse(frame, d, "key")
    got = to_numpy(inverse, d)
    assert np.all(got.pop("rank") == 0)
    assert {r.key for r in inverse.collect() if r.singular} == {"rank"}
    for key, m in regular.items():
        assert got[key] @ m == pytest.approx(np.eye(d), abs=1e-9)
    det = {r.key: r.det for r in matrix.determinant(frame, d, "key").collect()}
    assert det == pytest.approx({k: np.linalg.det(m) for k, m in matrices.items()}, abs=1e-9)
    turned = matrix.determinant(matrix.transpose(frame, "key"), d, "key")
    assert {r.key: r.det for r in turned.collect()} == pytest.approx(det, abs=1e-9)
    adjugate = to_numpy(matrix.adjugate(frame, d, "key"), d)
    for key, m in regular.items():
        assert adjugate[key] @ m == pytest.approx(det[key] * np.eye(d), abs=1e-8)
    upper = to_numpy(matrix.upper_triangle(frame.filter("key != 'rank'"), d, "key"), d)
    assert all(np.all(np.tril(u, -1) == 0) for u in upper.values())


def test_adjugate_of_rank_one_less():
    """By cofactors, which need no inverse."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(5, 5))
    m[4] = m[0] + m[1]
    want = np.empty((5, 5))
    for i in range(5):
        for j in range(5):
            minor = np.delete(np.delete(m, i, axis=0), j, axis=1)
            want[j, i] = (-1) ** (i + j) * np.linalg.det(minor)
    assert dense.adjugate(m[None])[0] == pytest.approx(want, abs=1e-10)


def test_empty_matrix_has_determinant_one():
    assert dense.determinant(np.empty((1, 0, 0))) == [1.0]


def test_transpose(spark):
    frame = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)], "i int, j int, v double")
    turned = matrix.transpose(frame)
    assert sorted(map(tuple, turned.collect())) == [(0, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0)]
    back = matrix.transpose(turned).collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, frame.collect()))


def test_matvec(spark):
    x = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "key string, i int, v double")
    m = coo(spark, {"a": TWO["a"]})
    keyed = matrix.matvec(m, x, "key")
    assert sorted(map(tuple, keyed.collect())) == [("a", 0, 4.0), ("a", 1, 7.0)]
    plain = matrix.matvec(m.drop("key"), x.drop("key"))
    assert sorted(map(tuple, plain.collect())) == [(0, 4.0), (1, 7.0)]
    with pytest.raises(Exception, match="too short"):
        matrix.matvec(m, x.filter("i = 0"), "key").collect()


def test_dense_needs_every_cell_once(spark):
    frame = coo(spark, {"a": TWO["a"]})
    assert matrix.coo_to_dense(frame, 2, "key").first().m == [2.0, 1.0, 1.0, 3.0]
    assert matrix.coo_to_dense(frame.drop("key"), 2).first().m == [2.0, 1.0, 1.0, 3.0]
    with pytest.raises(Exception, match="fewer than 4"):
        matrix.coo_to_dense(frame.filter("i = 0"), 2, "key").collect()
    with pytest.raises(Exception, match="repeated"):
        matrix.coo_to_dense(frame.union(frame), 2, "key").collect()
    with pytest.raises(Exception, match="outside"):
        matrix.coo_to_dense(frame, 1, "key").collect()


@pytest.mark.parametrize("d", [3, 5])
def test_one_matrix_with_nan_leaves_the_others_alone(spark, d):
    good = np.diag(np.arange(1.0, d + 1))
    bad = good.copy()
    bad[0, 0] = np.nan
    table = coo(spark, {"good": good.tolist(), "bad": bad.tolist()})
    for job in (matrix.inverse, matrix.adjugate):
        cells = to_numpy(job(table, d, "key").drop("singular"), d)
        assert np.isfinite(cells["good"]).all() and np.isnan(cells["bad"]).any()


@pytest.mark.parametrize("d", [3, 4])
@pytest.mark.parametrize("scale", [1e-120, 1e120])
def test_scale_does_not_make_singular(spark, d, scale):
    table = coo(spark, {"a": (np.eye(d) * scale).tolist()})
    rows = matrix.inverse(table, d, "key").collect()
    assert not any(r.singular for r in rows)
    assert all(abs(r.v * scale - (r.i == r.j)) < 1e-12 for r in rows)


def test_rank_two_matrix_is_singular(spark):
    table = coo(spark, {"a": [[0.1, 0.3, 0.1], [0.8, 0.1, 0.3], [0.9, 0.4, 0.4]]})
    assert all(r.singular and r.v == 0 for r in matrix.inverse(table, 3, "key").collect())


def test_sign_of_singular_matrix_is_positive_zero():
    stack = np.stack([np.diag([-1.0, 2.0, 0.0]), np.diag([-1.0, -2.0, 0.0])])
    det, sign, log_abs = dense.signed_determinant(stack)
    for values in (det, sign):
        assert (values == 0).all() and not np.signbit(values).any()
    assert np.isneginf(log_abs).all()
