"""Vectors and matrices from space-delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logistra.constants import BROADCAST_LIMIT
from logistra.operators.validate import checked
from logistra.operators.vectors import vector_to_indexed
from logistra.storage import stored

# The only spellings of non-finite numbers the text format accepts; Spark's
# cast alone would also take "inf", "nan" and other cases.
_SPECIAL_EXACT = r"^[\x00-\x20]*[+-]?(NaN|Infinity)[\x00-\x20]*$"


def _tokens(line: Column) -> Column:
    """Single-space tokens; trailing spaces are dropped, other empties stay."""
    return F.split(F.rtrim(line), " ")


def _numbers(tokens: Column) -> Column:
    return tokens.try_cast("array<double>")


def _bad_number(values: Column, tokens: Column) -> Column:
    infinite = float("inf")
    special = F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == infinite))
    misspelt = F.exists(
        tokens,
        lambda s: (F.isnan(s.try_cast("double")) | (F.abs(s.try_cast("double")) == infinite))
        & s.rlike("[iInN]")
        & ~s.rlike(_SPECIAL_EXACT),
    )
    return F.exists(values, F.isnull) | (special & misspelt)


def _parse(lines: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    split = lines.select(*keep, F.col(column).alias("line"), _tokens(F.col(column)).alias("tokens"))
    numbers = split.withColumn("numbers", _numbers(F.col("tokens")))
    return numbers.withColumn(
        "error",
        F.when(F.col("line").isNull(), F.lit("missing line")).when(
            _bad_number(F.col("numbers"), F.col("tokens")), F.lit("malformed number")
        ),
    )


def _outputs(labelled: bool) -> list[Column]:
    numbers = F.col("numbers")
    if not labelled:
        return [numbers.alias("phi")]
    return [
        F.slice(numbers, 1, F.size(numbers) - 1).alias("phi"),
        F.element_at(numbers, -1).alias("t"),
    ]


def _finish(parsed: DataFrame, keep: Sequence[str], labelled: bool, on_error: str):
    if on_error == "fail":
        good = checked(F.col("numbers"), F.col("error").isNull(), "malformed vector line")
        return parsed.withColumn("numbers", good).select(*keep, *_outputs(labelled))
    if on_error == "reject":
        good = parsed.filter(F.col("error").isNull()).select(*keep, *_outputs(labelled))
        bad = parsed.filter(F.col("error").isNotNull()).select(*keep, "line", "error")
        return good, bad
    raise ValueError(f"on_error must be 'fail' or 'reject', not {on_error!r}")


def parse_labelled(
    lines: DataFrame, column: str = "value", keep: Sequence[str] = (), on_error: str = "fail"
):
    """Lines to ``(*keep, phi, t)``: the last token is the target.

    ``fail`` returns the table; ``reject`` returns ``(good, rejects)``, where
    rejects are ``(*keep, line, error)``.
    """
    return _finish(_parse(lines, column, keep), keep, True, on_error)


def parse_vectors(
    lines: DataFrame, column: str = "value", keep: Sequence[str] = (), on_error: str = "fail"
):
    """Lines to ``(*keep, phi)``: every token is a feature."""
    return _finish(_parse(lines, column, keep), keep, False, on_error)


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("row_id"), "value"
    )


def load_labelled(spark: SparkSession, path: str, on_error: str = "fail"):
    """Text folder to ``(row_id, phi, t)``; ``row_id`` is unique, not consecutive."""
    return parse_labelled(_read_lines(spark, path), keep=["row_id"], on_error=on_error)


def load_vectors(spark: SparkSession, path: str, on_error: str = "fail"):
    """Text folder to ``(row_id, phi)``; ``row_id`` is unique, not consecutive."""
    return parse_vectors(_read_lines(spark, path), keep=["row_id"], on_error=on_error)


def load_matrix_coo(lines: DataFrame, row_id: str, column: str = "value") -> DataFrame:
    """One ``(i, j, v)`` row per feature cell; the last token is not read."""
    row = F.col(row_id).cast("bigint")
    tokens = lines.select(row.alias("i"), _tokens(F.col(column)).alias("tokens"))
    features = tokens.select("i", F.slice("tokens", 1, F.size("tokens") - 1).alias("tokens"))
    numbers = features.withColumn("numbers", _numbers(F.col("tokens")))
    fits = ~_bad_number(F.col("numbers"), F.col("tokens"))
    good = checked(F.col("numbers"), fits, "malformed matrix line")
    return vector_to_indexed(numbers.withColumn("numbers", good), ["i"], "numbers", "j")


def with_row_number(spark: SparkSession, path: str) -> DataFrame:
    """Text folder to ``(row_id, value)`` with consecutive numbers in file order.

    Only one row per file split is counted and accumulated; the lines
    themselves are not sorted or shuffled while that table is small enough to
    broadcast.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("mark"),
        "value",
    )
    splits, _ = stored(
        lines.groupBy("file", "start").agg(
            F.count("*").alias("rows"), F.min("mark").alias("first_mark")
        ),
        "splits",
    )
    # Split offsets: a running sum over one row per split. Files are dealt out
    # in ranges of their names, so the only unpartitioned window is over ranges.
    files, _ = stored(
        splits.groupBy("file")
        .agg(F.sum("rows").alias("file_rows"))
        .repartitionByRange("file")
        .withColumn("range", F.spark_partition_id()),
        "files",
    )
    ranges = files.groupBy("range").agg(F.sum("file_rows").alias("range_rows"))
    ranges = running_total(ranges, ["range"], "range_rows", "range_offset")
    files = running_total(files, ["file"], "file_rows", "file_offset", by=["range"])
    files = files.join(ranges, "range").select(
        "file", (F.col("range_offset") + F.col("file_offset")).alias("file_offset")
    )
    size = splits.agg(F.sum(F.length("file") + 64).alias("bytes")).first()["bytes"] or 0
    offsets = splits.join(files, "file")
    offsets = running_total(offsets, ["start"], "rows", "offset", by=["file"]).select(
        "file", "start", "first_mark", (F.col("file_offset") + F.col("offset")).alias("offset")
    )
    if size <= BROADCAST_LIMIT:
        offsets = F.broadcast(offsets)
    return lines.join(offsets, ["file", "start"]).select(
        (F.col("offset") + F.col("mark") - F.col("first_mark")).alias("row_id"), "value"
    )


def running_total(
    df: DataFrame, order: Sequence[str], value: str, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Text folder to ``(i, j, v)`` with consecutive row numbers in file order."""
    return load_matrix_coo(with_row_number(spark, path), "row_id")
