"""Vectors as arrays and as indexed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.operators.sums import ARRAY, CELLS, Out, array_sums, summable
from logistra.operators.validate import checked


def key_list(key: str | Sequence[str] | None) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def unique_cells(df: DataFrame, index: Sequence[str], value: str) -> DataFrame:
    """``df`` by ``index``; a null or repeated index or a null value fails the job.

    The grouping keeps at most one value per index, so whatever gathers the
    cells of a key afterwards is bounded by the size of the vector or matrix.
    """
    cells = df.groupBy(*index).agg(F.count("*").alias("copies"), F.first(value).alias(value))
    single = F.col("copies") == 1
    for column in index:
        single = single & F.col(column).isNotNull()
    kept = checked(F.col(value), single, f"repeated or null {list(index)}")
    return cells.select(*index, kept.alias(value))


def indexed_to_dense(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    index: str = "i",
    value: str = "v",
    out: str = "phi",
) -> DataFrame:
    """``(key, index, value)`` rows to one ``(key, array)`` row in index order.

    A repeated index, or a gap in 0..max, fails the job.
    """
    keys = key_list(key)
    cells = unique_cells(df, [*keys, index], value)
    gathered = cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(index, value))).alias("cells")
    )
    if not keys:
        gathered = gathered.filter(F.size("cells") > 0)
    places = F.transform(F.col("cells"), lambda cell: cell[index])
    complete = (F.array_min(places) == 0) & (F.array_max(places) == F.size("cells") - 1)
    vector = F.transform("cells", lambda cell: cell[value])
    whole = checked(vector, complete, "indexed vector has a gap")
    return gathered.select(*keys, whole.alias(out))


def vector_to_indexed(
    df: DataFrame, keep: Sequence[str] = (), phi: str = "phi", index: str = "i", value: str = "v"
) -> DataFrame:
    """One row per array cell, zero-based.

    The outer form with a filter behind it: for the plain form the optimizer
    adds a test of the array's size next to the scan, which computes the array
    of every row a second time.
    """
    cells = df.select(*keep, F.posexplode_outer(phi).alias(index, value))
    return cells.filter(F.col(index).isNotNull())


def explode_array(df: DataFrame, key: str, values: str) -> DataFrame:
    """``(key, value as text)``, one row per array cell."""
    cells = vector_to_indexed(df, [key], values, value="value")
    return cells.select(key, F.col("value").cast("string").alias("value"))


def vector_sum(df: DataFrame, key: str | Sequence[str], phi: str = "phi") -> DataFrame:
    """``(key, i, v)``: sum of the vectors of each key, cell by cell.

    Nulls add nothing; a cell that is null in all of a key's vectors is null. Keys
    of floating point or nested types are summed cell by cell, as only Spark tells
    them apart as Spark does.
    """
    keys = key_list(key)
    vectors = df.select(*keys, F.col(phi).cast(ARRAY).alias(CELLS))
    if summable([df.schema[k].dataType for k in keys]):
        return array_sums(vectors, keys, CELLS, out=Out(None, ["i", "v"]))
    cells = vector_to_indexed(vectors, keys, CELLS)
    return cells.groupBy(*keys, "i").agg(F.sum("v").alias("v"))


def sum_by_key(
    df: DataFrame, key: str | Sequence[str], value: str, out: str = "total"
) -> DataFrame:
    """Sum of a number column per key; int sums are bigint and do not wrap."""
    return df.groupBy(*key_list(key)).agg(F.sum(value).alias(out))


def vector_subtract(
    a: DataFrame, b: DataFrame, key: str | Sequence[str] | None = None, value: str = "v"
) -> DataFrame:
    """``a - b`` cell by cell; an index present on one side only fails the job."""
    index = [*key_list(key), "i"]
    left = a.select(*index, F.col(value).alias("left"))
    right = b.select(*index, F.col(value).alias("right"))
    difference = F.col("left") - F.col("right")
    both = difference.isNotNull()
    return left.join(right, index, "full_outer").select(
        *index, checked(difference, both, "vectors differ in length").alias(value)
    )
