"""Checks on vector tables.

A failing check is an expression around the value it guards, not a filter: a
filter is pushed towards the scan, where it would compute the guarded
expressions once more per reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logistra.constants import NAN_FILL
from logistra.functions.logistic import name, nan_guard


def checked(value: Column, condition: Column, message: str) -> Column:
    """``value`` where ``condition`` holds; elsewhere, or if null, the task fails."""
    return F.coalesce(F.when(condition, value), F.raise_error(F.lit(message)))


def check_dims(df: DataFrame, d: int, on_error: str = "fail", phi: str = "phi"):
    """Rows whose vector is present, complete and of length ``d``.

    ``fail`` returns the table, whose vectors fail the task that reads a bad
    one; ``reject`` returns ``(good, rejects)``.
    """
    vector = F.col(phi)
    fits = (F.size(vector) == d) & ~F.exists(vector, F.isnull)
    if on_error == "fail":
        message = f"feature vector is missing, incomplete or not of length {d}"
        return df.withColumn(phi, checked(vector, fits, message))
    if on_error == "reject":
        fits = F.coalesce(fits, F.lit(False))
        return df.filter(fits), df.filter(~fits)
    raise ValueError(f"on_error must be 'fail' or 'reject', not {on_error!r}")


def observe_rows(df: DataFrame, d: int) -> tuple[DataFrame, Observation]:
    """The rows fit for training, and counts that the first pass over them fills.

    The counts are ``rows``, ``rejected`` (a vector that is missing, incomplete or not of
    length d, or no target) and ``guarded`` (rows with a NaN, whose cells the guard
    replaces). They cost no pass of their own: Spark counts while the rows are read. A
    task that runs again is counted once.
    """
    fits = (F.size("phi") == d) & ~F.exists("phi", F.isnull) & F.col("t").isNotNull()
    fits = F.coalesce(fits, F.lit(False))
    holds_nan = F.exists("phi", F.isnan) | F.isnan("t")
    counts = Observation()
    watched = df.observe(
        counts,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~fits).alias("rejected"),
        F.count_if(fits & holds_nan).alias("guarded"),
    )
    return watched.where(fits), counts


def guard_cells(df: DataFrame, value: str = "v", fill: float = NAN_FILL) -> DataFrame:
    """Replace NaN in ``value`` and mark the replaced cells in ``replaced``."""
    return df.withColumn("replaced", F.isnan(value)).withColumn(
        value, F.expr(nan_guard(name(value), fill))
    )


def replaced_count(guarded: DataFrame) -> DataFrame:
    """Number of cells that ``guard_cells`` replaced."""
    return guarded.agg(F.count_if("replaced").alias("replaced"))
