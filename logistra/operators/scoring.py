"""Row-wise jobs over a vector table ``(phi, t)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.functions import logistic
from logistra.operators.vectors import indexed_to_dense, vector_to_indexed

# A list of numbers, or the name of an array column.
Weights = Sequence[float] | str


def with_weights(df: DataFrame, model: DataFrame, out: str = "w") -> DataFrame:
    """Attach the model ``(i, w)`` to every row as one array column.

    The broadcast side is a single row of as many doubles as there are
    features: it does not grow with the data.
    """
    dense = indexed_to_dense(model.select("i", "w"), value="w", out=out)
    return df.crossJoin(F.broadcast(dense))


def score(df: DataFrame, weights: Weights) -> DataFrame:
    """Adds margin, p, resid and curv."""
    return (
        df.selectExpr("*", f"{logistic.margin('phi', weights)} AS margin")
        .selectExpr("*", f"{logistic.sigmoid('margin')} AS p")
        .selectExpr("*", "p - t AS resid", f"{logistic.curvature('p')} AS curv")
    )


def row_gradient(df: DataFrame, weights: Weights, guard: str = "residual") -> DataFrame:
    """Adds ``grad``, the row's phi * (p - t).

    ``guard`` says what a NaN replaces: with ``residual`` the whole gradient
    of the row, with ``element`` the NaN cells alone.
    """
    cells = {
        "residual": logistic.gradient_cell("x", "resid"),
        "element": logistic.nan_guard("x * resid"),
    }
    return score(df, weights).selectExpr("*", f"transform(phi, x -> {cells[guard]}) AS grad")


def row_curvature(df: DataFrame, weights: Weights) -> DataFrame:
    """Adds ``h``: d * p(1-p) * sum of phi_i^2."""
    squares = "aggregate(phi, 0D, (total, x) -> total + x * x)"
    return score(df, weights).selectExpr("*", f"size(phi) * curv * {squares} AS h")


def row_hessian_coo(df: DataFrame, weights: Weights, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, i, j, h)``: all d^2 cells of every row's Hessian."""
    rows = vector_to_indexed(score(df, weights), [*keep, "phi", "curv"], value="xi")
    cells = vector_to_indexed(rows, [*keep, "i", "xi", "curv"], index="j", value="xj")
    h = F.expr(logistic.hessian_cell("xi", "xj", "curv"))
    return cells.select(*keep, "i", "j", h.alias("h"))


def row_hessian_dense(df: DataFrame, weights: Weights) -> DataFrame:
    """Adds ``hessian``, the row's d x d matrix as nested arrays; no NaN guard."""
    cells = "transform(phi, x -> transform(phi, y -> curv * (x * y)))"
    return score(df, weights).selectExpr("*", f"{cells} AS hessian")
