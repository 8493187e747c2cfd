"""Newton training of one model over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from logistra.constants import ITERATIONS, PIVOT_TOLERANCE, TREE_TASKS
from logistra.functions import dense
from logistra.operators.exact import exact_system
from logistra.operators.moments import (
    cell_sums,
    design,
    gradient_cells,
    hessian_cells,
    matrix_arrays,
    packed,
    strategy_for,
)
from logistra.operators.sums import CELLS, PART
from logistra.operators.vectors import indexed_to_dense
from logistra.plans.journal import Journal
from logistra.plans.layout import Shape, Stored, measured_pass

STEP = "i int, w double, singular boolean"


def model_frame(spark: SparkSession, weights: Sequence[float]) -> DataFrame:
    """``(i, w)`` rows of a weight vector."""
    return spark.createDataFrame(
        [(i, float(w)) for i, w in enumerate(weights)], "i int, w double"
    )


def model_weights(model: DataFrame) -> list[float]:
    """Weight vector of an ``(i, w)`` model; its length is the feature count."""
    dense_row = indexed_to_dense(model.select("i", "w"), value="w", out="w").first()
    if dense_row is None:
        raise ValueError("the model has no weights")
    return list(dense_row["w"])


class _Pass:
    """The training table, and one aggregation over it per step."""

    def __init__(self, df: DataFrame, d: int, strategy: str):
        self.d = d
        self.cells = hessian_cells(d) + gradient_cells(d)
        self.strategy = strategy_for(d) if strategy == "auto" else strategy
        if self.strategy not in ("wide", "blas", "exact"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.rows = design(df, d) if self.strategy == "wide" else packed(df, d)
        self.columns = [*([f"x{i}" for i in range(d)] if self.strategy == "wide" else ["phi"]), "t"]
        self.tree = False
        self.stored: Stored | None = None
        # How the rows are to be stored once the first pass has measured them.
        self.measuring: tuple[str, bool] | None = None

    def store(self, collapse: str, persist: bool) -> None:
        if collapse == "auto" and self.strategy == "exact":
            # What is measured depends on how the rows are dealt, and a count times a
            # term is rounded where equal terms are not.
            collapse = "never"
        if collapse == "auto":
            self.measuring = collapse, persist
        else:
            self._stored(Stored(self.rows, self.columns, collapse, persist))

    def _stored(self, stored: Stored) -> None:
        self.stored, self.rows = stored, stored.rows
        shape = stored.shape
        self.tree = not stored.collapsed and shape is not None and shape.tasks > TREE_TASKS

    def system(self, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """H and g at ``weights``: d^2 / 2 + d sums reach the driver, never rows.

        The first pass measures the rows that it reads; how later passes get them
        follows from that.
        """
        if self.measuring is None:
            return self._sums(self.rows, weights)
        rows, seen = measured_pass(self.rows, self.columns)
        out = self._sums(rows, weights)
        self._stored(Stored(self.rows, self.columns, *self.measuring, shape=Shape(**seen.get)))
        self.measuring = None
        return out

    def _sums(self, rows: DataFrame, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        if self.strategy == "wide":
            row = cell_sums(rows, self.d, weights, self.cells, tree=self.tree).collect()[0]
            sums = [v or 0.0 for v in row]
        elif self.strategy == "exact":
            found = exact_system(rows, self.d, weights, self.cells, self.tree).collect()
            known = {(row["i"], row["j"]): row["v"] for row in found}
            sums = [known.get(cell, 0.0) for cell in self.cells]
        else:
            arrays = matrix_arrays(rows, self.d, weights, self.cells, self.tree)
            parts = sorted(arrays.collect(), key=lambda row: row[PART])
            sums = [v for row in parts for v in row[CELLS]] or [0.0] * len(self.cells)
        full = np.zeros((self.d, self.d + 1))
        for (i, j), v in zip(self.cells, sums, strict=True):
            full[i, j] = v
            if j < self.d:
                full[j, i] = v
        return full[:, : self.d], full[:, self.d]

    def close(self) -> None:
        if self.stored is not None:
            self.stored.close()


def newton_step(
    df: DataFrame,
    weights: Sequence[float],
    strategy: str = "auto",
    tolerance: float = PIVOT_TOLERANCE,
) -> DataFrame:
    """``(i, w_old, g, update, w_new, singular)`` of one full Newton step.

    A singular Hessian leaves the weights as they are.
    """
    data = _Pass(df, len(weights), strategy)
    h, g = data.system(weights)
    update, singular = dense.newton_update(h[None], g[None], tolerance)
    rows = [
        (i, float(w), float(g[i]), float(u), float(w - u), bool(singular[0]))
        for i, (w, u) in enumerate(zip(weights, update[0], strict=True))
    ]
    return df.sparkSession.createDataFrame(
        rows, "i int, w_old double, g double, update double, w_new double, singular boolean"
    )


def newton_train(
    df: DataFrame,
    d: int,
    iterations: int = ITERATIONS,
    init: DataFrame | None = None,
    history: bool = False,
    strategy: str = "auto",
    collapse: str = "auto",
    persist: bool = False,
    tolerance: float = PIVOT_TOLERANCE,
    journal: str | None = None,
) -> DataFrame:
    """``(i, w, singular)`` after exactly ``iterations`` full Newton steps.

    Training starts from 0, or from ``init``, an ``(i, w)`` model. With
    ``history`` the weights after every step are returned with ``iteration``
    1, 2, ... ``singular`` tells that the step found a singular Hessian and
    kept the weights. ``collapse`` (auto, always, never) groups equal rows
    once; ``persist`` keeps the rows between the steps, which pays off for
    costlier sources such as text or joins. ``journal`` is a folder that keeps every finished
    step: a run that broke off goes on behind its last one, over the same rows.
    With the ``strategy`` exact the weights are the same to the last bit however the
    rows are dealt; equal rows are then grouped only if ``collapse`` is always.
    """
    spark = df.sparkSession
    weights = np.zeros(d) if init is None else np.array(model_weights(init))
    if weights.size != d:
        raise ValueError(f"{weights.size} weights for {d} features")
    log, rows = None, []
    if journal is not None:
        settings = {"d": d, "start": weights.tolist(), "tolerance": tolerance, "strategy": strategy}
        log = Journal(spark, journal, settings)
        for iteration in range(1, min(log.finished(), iterations) + 1):
            step = sorted(log.read(iteration).collect(), key=lambda row: row["i"])
            weights = np.array([row["w"] for row in step])
            rows += [(iteration, row["i"], row["w"], row["singular"]) for row in step]
    data = _Pass(df, d, strategy)
    first = len(rows) // d + 1
    try:
        if first <= iterations:
            data.store(collapse, persist)
        for iteration in range(first, iterations + 1):
            h, g = data.system(weights.tolist())
            update, singular = dense.newton_update(h[None], g[None], tolerance)
            weights = weights - update[0]
            step = [(i, float(w), bool(singular[0])) for i, w in enumerate(weights)]
            if log is not None:
                log.write(iteration, spark.createDataFrame(step, STEP).coalesce(1))
            rows += [(iteration, *row) for row in step]
    finally:
        data.close()
    if not iterations:
        rows = [(0, i, float(w), False) for i, w in enumerate(weights)]
    steps = spark.createDataFrame(rows if history else rows[-d:], f"iteration int, {STEP}")
    return steps if history else steps.drop("iteration")
