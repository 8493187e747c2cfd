"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact name, then by name in any case.

    Extra columns never clash: ``text`` is found beside ``TEXT`` or a second
    ``text``, of which the first counts.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    lower = [c.lower() for c in df.columns]
    places = [df.columns.index(n) if n in df.columns else lower.index(n.lower()) for n in names]
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(0))


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"
