"""Vector tables built from the relational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vector_table(
    df: DataFrame, features: Sequence[Column], target: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """``(*keep, phi, t)`` from feature and target expressions."""
    phi = F.array(*[feature.cast("double") for feature in features])
    return df.select(*keep, phi.alias("phi"), target.cast("double").alias("t"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line(spark: SparkSession, folder: str) -> DataFrame:
    features = [F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount") * 10]
    keep = ["l_orderkey", "l_linenumber", "l_suppkey"]
    return vector_table(
        table(spark, folder, "lineitem"), features, F.col("l_returnflag") == "R", keep
    )


def line_wide(
    spark: SparkSession, folder: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Five features per line, for matrices past the closed forms."""
    features = [
        F.lit(1.0),
        F.col("l_quantity") / 50,
        F.col("l_discount") * 10,
        F.col("l_tax") * 10,
        F.col("l_extendedprice") / 100000,
    ]
    return vector_table(
        table(spark, folder, "lineitem"), features, F.col("l_returnflag") == "R", ["l_suppkey", *keep]
    )


def line_products(
    spark: SparkSession, folder: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Ten features per line: three measures, their squares and their products."""
    q, d, x = F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10
    features = [F.lit(1.0), q, d, x, q * q, d * d, x * x, q * d, q * x, d * x]
    return vector_table(
        table(spark, folder, "lineitem"), features, F.col("l_returnflag") == "R", ["l_suppkey", *keep]
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    features = [F.lit(1.0), F.col("value") / 100, F.col("event_type") == "error"]
    return vector_table(
        table(spark, folder, "events"), features, F.col("user_id") % 2, ["event_id"]
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    features = [
        F.lit(1.0),
        F.col("o_totalprice") / 100000,
        F.col("o_orderpriority") == "1-URGENT",
    ]
    return vector_table(
        table(spark, folder, "orders"), features, F.col("o_orderstatus") == "F", ["o_orderkey"]
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    features = [F.lit(1.0), F.log1p("n_chars"), F.col("lang") == "en"]
    joined = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars", "lang"), "doc_id"
    )
    return vector_table(joined, features, F.col("quality"), ["doc_id"])


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding").cast("array<double>").alias("phi"),
        (F.col("label") == 0).cast("double").alias("t"),
    )
