import math

import pytest
from pyspark.sql import functions as F

from helpers import lines
from logistra.operators.validate import check_dims, guard_cells, replaced_count
from logistra.sources import model, text


def test_labelled_lines(spark):
    rows = text.parse_labelled(lines(spark, ["1 0.5 0", "1 1e3 1  ", "+1 1d 0x1p3", "1 \t1 NaN"]))
    got = [(row.phi, row.t) for row in rows.collect()]
    assert got[:3] == [([1.0, 0.5], 0.0), ([1.0, 1000.0], 1.0), ([1.0, 1.0], 8.0)]
    assert got[3][0] == [1.0, 1.0] and math.isnan(got[3][1])


def test_infinities(spark):
    rows = text.parse_vectors(lines(spark, ["Infinity -Infinity +Infinity NaN"])).first().phi
    assert rows[:3] == [math.inf, -math.inf, math.inf] and math.isnan(rows[3])


BAD = ["", "1 2 x", " 1 2", "1  2", "   ", "1 inf 0", "1 nan 0", "1 INFINITY 0", None]


def test_bad_lines_are_rejected(spark):
    good, bad = text.parse_labelled(lines(spark, [*BAD, "1 2 0"]), on_error="reject")
    assert [(row.phi, row.t) for row in good.collect()] == [([1.0, 2.0], 0.0)]
    rejected = bad.collect()
    assert sorted(str(row.line) for row in rejected) == sorted(map(str, BAD))
    assert {row.error for row in rejected} == {"malformed number", "missing line"}


@pytest.mark.parametrize("bad", BAD)
def test_bad_lines_fail(spark, bad):
    with pytest.raises(Exception, match="malformed vector line"):
        text.parse_labelled(lines(spark, [bad])).collect()


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        text.parse_labelled(lines(spark, ["1 2"]), on_error="ignore")


def test_unlabelled_lines(spark):
    assert text.parse_vectors(lines(spark, ["1 2 3"])).first().phi == [1.0, 2.0, 3.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 0\n1 3 1\n")
    (tmp_path / "b.txt").write_text("1 4 0\n")
    rows = text.load_labelled(spark, str(tmp_path)).collect()
    assert sorted((row.phi[1], row.t) for row in rows) == [(2.0, 0.0), (3.0, 1.0), (4.0, 0.0)]
    assert len({row.row_id for row in rows}) == 3
    assert sorted(row.phi for row in text.load_vectors(spark, str(tmp_path)).collect()) == [
        [1.0, 2.0, 0.0],
        [1.0, 3.0, 1.0],
        [1.0, 4.0, 0.0],
    ]


def test_matrix_drops_the_label_unread(spark):
    rows = text.load_matrix_coo(lines(spark, ["1 2 label"]).selectExpr("7L AS r", "value"), "r")
    assert [tuple(row) for row in rows.collect()] == [(7, 0, 1.0), (7, 1, 2.0)]
    assert dict(rows.dtypes) == {"i": "bigint", "j": "int", "v": "double"}


def test_matrix_rows_are_numbered_across_files_and_splits(spark, tmp_path):
    names = ["a", "b", "c"]
    for place, name in enumerate(names):
        body = "".join(f"{place} {n} 0\n" for n in range(400 * (place + 1)))
        (tmp_path / f"{name}.txt").write_text(body)
    split_size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split_size)
    spark.conf.set(split_size, "1000")
    try:
        cells = text.load_matrix(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(split_size, before)
    got = {}
    for cell in cells:
        got.setdefault(cell.i, {})[cell.j] = int(cell.v)
    want = [(place, n) for place in range(3) for n in range(400 * (place + 1))]
    assert [(got[i][0], got[i][1]) for i in range(len(got))] == want


def test_check_dims(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (4, None), (5, [1.0, None])],
        "id int, phi array<double>",
    )
    good, bad = check_dims(rows, 2, on_error="reject")
    assert [row.id for row in good.collect()] == [1]
    assert sorted(row.id for row in bad.collect()) == [2, 3, 4, 5]
    assert check_dims(rows.filter("id = 1"), 2).count() == 1
    for bad_id in [2, 3, 4, 5]:
        with pytest.raises(Exception, match="feature vector"):
            check_dims(rows.filter(f"id = {bad_id}"), 2).collect()


def test_nan_guard(spark):
    cells = spark.createDataFrame([(1.5,), (float("nan"),)], "v double")
    guarded = guard_cells(cells)
    assert [row.v for row in guarded.collect()] == [1.5, 4.9e-324]
    assert replaced_count(guarded).first().replaced == 1


def test_model_files(spark, tmp_path):
    path = str(tmp_path / "model")
    schema = "iteration int, i int, w double"
    first = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.5), (2, 0, 0.6)], schema)
    model.save_model(first, path)
    assert sorted(map(tuple, model.load_model(spark, path, 1).collect())) == [(0, 0.5), (1, 1.5)]
    assert [tuple(r) for r in model.load_model(spark, path).collect()] == [(0, 0.6)]
    again = spark.createDataFrame([(2, 0, 0.7)], schema)
    model.save_model(again, path)
    # What was stored before is gone as a whole.
    assert model.load_history(spark, path).count() == 1
    assert [tuple(r) for r in model.load_model(spark, path).collect()] == [(0, 0.7)]
    model.save_model(again.drop("iteration"), path)
    assert [tuple(r) for r in model.load_model(spark, path).collect()] == [(0, 0.7)]
    failing = again.withColumn("w", F.expr("CAST(raise_error('no') AS double)"))
    with pytest.raises(Exception, match="no"):
        model.save_model(failing, path)
    assert model.load_history(spark, path).count() == 1
    # A path that only begins alike is another model.
    model.save_model(model.load_history(spark, path), path + "2")
    # A model may be saved where it is read from.
    model.save_model(model.load_history(spark, path).withColumn("w", F.expr("w + 1")), path)
    assert [tuple(r) for r in model.load_model(spark, path).collect()] == [(0, 1.7)]


def test_readers_never_miss_the_model(spark, tmp_path):
    """While versions replace each other, every read gives one whole version."""
    import threading

    path = str(tmp_path / "model")
    rows = lambda n: spark.range(4).selectExpr("CAST(id AS int) AS i", f"CAST({n} AS double) AS w")
    model.save_model(rows(0), path)
    seen, failed, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                seen.append([row.w for row in model.load_model(spark, path).collect()])
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(1, 8):
            before = len(seen)
            model.save_model(rows(n), path)
            while len(seen) == before and not failed:
                done.wait(0.01)
    finally:
        done.set()
        reader.join()
    assert not failed
    assert all(len(found) == 4 and len(set(found)) == 1 for found in seen)
    numbers = [found[0] for found in seen]
    assert numbers == sorted(numbers) and len(set(numbers)) > 3
    folders = [entry.name for entry in (tmp_path / "model").iterdir() if entry.name.startswith("version-")]
    assert len(folders) == model.KEPT_VERSIONS


def test_a_broken_switch_leaves_the_model(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    model.save_model(spark.createDataFrame([(0, 1.0)], "i int, w double"), path)

    def broken(self, version):
        raise OSError("driver lost")

    monkeypatch.setattr(model._Store, "point_to", broken)
    with pytest.raises(OSError, match="lost"):
        model.save_model(spark.createDataFrame([(0, 2.0)], "i int, w double"), path)
    assert [tuple(r) for r in model.load_model(spark, path).collect()] == [(0, 1.0)]


def test_models_without_versions_are_read_and_replaced(spark, tmp_path):
    path = str(tmp_path / "model")
    plain = spark.createDataFrame([(3, 0, 1.0)], "iteration int, i int, w double")
    plain.write.partitionBy("iteration").parquet(path)
    assert [tuple(r) for r in model.load_model(spark, path).collect()] == [(0, 1.0)]
    model.save_model(plain.withColumn("w", F.lit(2.0)), path)
    assert [tuple(r) for r in model.load_history(spark, path).select("iteration", "w").collect()] == [(3, 2.0)]
