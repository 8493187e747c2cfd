"""The stored form of a training table that several steps read."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from logistra.constants import SPREAD_ROWS


class Shape(NamedTuple):
    rows: int
    distinct: int
    tasks: int
    keys: int = 1
    # Keys of each task, added up.
    pairs: int = 1

    def collapses(self) -> bool:
        """Whether grouping equal rows is sure to be cheap.

        With D distinct rows and P tasks, the grouping shuffles at most D * P
        rows after map-side combine. It pays off if that is at most a quarter
        of the table.
        """
        return 4 * self.distinct * self.tasks <= self.rows


def _marked(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with hashes of row and key and the task, and the aggregates that measure them."""
    key = F.xxhash64(*keys) if keys else F.lit(0)
    marked = rows.select(
        "*", F.xxhash64(*columns).alias("_row"), F.spark_partition_id().alias("_task"), key.alias("_key")
    )
    counts = [
        F.count(F.lit(1)).alias("rows"),
        F.approx_count_distinct("_row").alias("distinct"),
        F.approx_count_distinct("_task").alias("tasks"),
        F.approx_count_distinct("_key").alias("keys"),
    ]
    # Without keys there is one for all tasks, as for a Shape that names none.
    if keys:
        counts.append(F.approx_count_distinct(F.xxhash64("_key", "_task")).alias("pairs"))
    return marked, counts


def measure(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> Shape:
    """Row count, and estimates of distinct rows, of scan tasks, of distinct keys and of those of each task.

    The estimates choose the plan only; no result depends on them.
    """
    marked, counts = _marked(rows, columns, keys)
    return Shape(**marked.agg(*counts).first().asDict())


def measured_pass(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``rows`` that are measured by the pass that reads them; the observation then has the shape."""
    marked, counts = _marked(rows, columns, ())
    seen = Observation()
    return marked.observe(seen, *counts).select(rows.columns), seen


def collapse_copies(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Equal rows as one row whose ``n`` is the sum of theirs."""
    return rows.groupBy(*columns).agg(F.sum("n").alias("n"))


class Stored:
    """The rows that every step of a training run reads.

    With ``collapse`` auto the table is measured, unless its ``shape`` is known. Equal rows are grouped
    if that is cheap, and a table that came in fewer tasks than the cluster
    has cores is spread over all of them; the result is kept in executor
    memory and disk, and a lost executor costs the recomputation of its part.
    Otherwise the steps read the source again, which over six steps of a
    column store costs about as much as keeping the rows and needs no room.
    ``persist`` keeps them in any case, for costlier sources such as text or
    joins.
    """

    def __init__(
        self,
        rows: DataFrame,
        columns: Sequence[str],
        collapse: str,
        persist: bool,
        keys: Sequence[str] = (),
        shape: Shape | None = None,
    ):
        if collapse not in ("auto", "always", "never"):
            raise ValueError(f"collapse must be auto, always or never, not {collapse!r}")
        self.shape = shape
        if shape is None and collapse == "auto":
            self.shape = measure(rows, columns, keys)
        self.collapsed = collapse == "always"
        spread = False
        if self.shape is not None:
            cores = rows.sparkSession.sparkContext.defaultParallelism
            self.collapsed = self.shape.collapses()
            spread = self.shape.tasks < cores and self.shape.rows >= SPREAD_ROWS
        if self.collapsed:
            rows = collapse_copies(rows, columns)
        elif spread:
            rows = rows.repartition(cores)
        self.rows = rows
        if self.collapsed or spread or persist:
            self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

    def count(self) -> int:
        """Rows of the source if they were measured, else of the stored form."""
        return self.rows.count() if self.shape is None else self.shape.rows

    def replace(self, rows: DataFrame) -> None:
        """Store ``rows``, which derive from the stored ones, instead of them."""
        new = rows.persist(StorageLevel.MEMORY_AND_DISK)
        new.count()
        self.rows.unpersist()
        self.rows = new

    def close(self) -> None:
        self.rows.unpersist()
