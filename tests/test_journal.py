import numpy as np
import pytest

from helpers import vectors
from logistra.operators.validate import observe_rows
from logistra.plans import journal, keyed, newton
from pyspark.sql import functions as F


class Lost(Exception):
    pass


def break_after(monkeypatch, step):
    """The driver is lost when it begins to write the step behind ``step``."""
    write = journal.Journal.write

    def broken(self, number, table):
        if number > step:
            # What an unfinished write leaves: files, but no commit.
            path = self.step_path(number)
            table.limit(1).write.mode("overwrite").parquet(path)
            self._files.delete(self._at(f"iteration={number}/_SUCCESS"), False)
            raise Lost
        return write(self, number, table)

    monkeypatch.setattr(journal.Journal, "write", broken)


def rows(spark, d, n=300):
    rng = np.random.default_rng(d)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, d - 1))])
    return vectors(spark, [(row.tolist(), float(rng.random() < 0.4)) for row in x], 3)


@pytest.mark.parametrize("d", [3, 10])
def test_whole_table_training_goes_on(spark, tmp_path, monkeypatch, d):
    table, path = rows(spark, d), str(tmp_path / "run")
    want = newton.newton_train(table, d, history=True).collect()
    with monkeypatch.context() as patch:
        break_after(patch, 3)
        with pytest.raises(Lost):
            newton.newton_train(table, d, journal=path)
    passes, system = [], newton._Pass.system
    monkeypatch.setattr(newton._Pass, "system", lambda self, w: passes.append(1) or system(self, w))
    got = newton.newton_train(table, d, history=True, journal=path).collect()
    assert len(passes) == 3
    assert [(r.iteration, r.i, r.singular) for r in got] == [(r.iteration, r.i, r.singular) for r in want]
    assert [r.w for r in got] == pytest.approx([r.w for r in want], rel=1e-9)
    # A finished run is read back: no pass over the rows, not even a readable one.
    gone = table.withColumn("t", F.expr("CAST(raise_error('read') AS double)"))
    again = newton.newton_train(gone, d, history=True, journal=path).collect()
    assert again == got and len(passes) == 3


@pytest.mark.parametrize("d", [3, 10])
def test_keyed_training_goes_on(spark, tmp_path, monkeypatch, d):
    table = rows(spark, d).withColumn("key", F.expr("CAST(abs(hash(phi)) % 2 AS int)"))
    want = {(r.iteration, r.key, r.i): r.w for r in keyed.newton_train_by(table, "key", d, history=True).collect()}
    path = str(tmp_path / "run")
    with monkeypatch.context() as patch:
        break_after(patch, 3)
        with pytest.raises(Lost):
            keyed.newton_train_by(table, "key", d, journal=path)
    written, write = [], journal.Journal.write
    monkeypatch.setattr(
        journal.Journal, "write", lambda self, n, t: written.append(n) or write(self, n, t)
    )
    got = keyed.newton_train_by(table, "key", d, history=True, journal=path).collect()
    assert written == [4, 5, 6]
    assert {(r.iteration, r.key, r.i) for r in got} == want.keys()
    assert all(r.w == pytest.approx(want[r.iteration, r.key, r.i], rel=1e-9) for r in got)
    last = keyed.newton_train_by(table, "key", d, iterations=2, journal=path).collect()
    assert all(r.w == pytest.approx(want[2, r.key, r.i], rel=1e-9) for r in last)


def test_journals_of_other_runs_are_refused(spark, tmp_path):
    table, path = rows(spark, 3), str(tmp_path / "run")
    newton.newton_train(table, 3, iterations=1, journal=path)
    start = newton.model_frame(spark, [0.1, 0.0, 0.0])
    with pytest.raises(ValueError, match="another run"):
        newton.newton_train(table, 3, init=start, journal=path)
    with pytest.raises(ValueError, match="another run"):
        keyed.newton_train_by(table.withColumn("key", F.lit(1)), "key", 3, journal=path)


def test_counts_come_with_the_first_pass(spark):
    table = rows(spark, 3).union(
        spark.createDataFrame(
            [([1.0, float("nan"), 0.0], 1.0), ([1.0], 0.0), (None, 1.0), ([1.0, 2.0, None], 0.0), ([1.0, 2.0, 3.0], None)],
            "phi array<double>, t double",
        )
    )
    fit, counts = observe_rows(table, 3)
    got = newton.newton_train(fit, 3, iterations=1, collapse="never").collect()
    assert counts.get == {"rows": 305, "rejected": 4, "guarded": 1}
    clean = newton.newton_train(rows(spark, 3), 3, iterations=1).collect()
    assert [r.w for r in got] == pytest.approx([r.w for r in clean], rel=1e-9)
