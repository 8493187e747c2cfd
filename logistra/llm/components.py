"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.storage import drop_table, stored


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of ``links(a, b)``: the smallest node that it reaches.

    Every round a node takes the smallest label among its neighbours and then
    that label's own label, so long chains shrink by halves. Labels are written
    to the shared folder each round; all steps combine before they shuffle, and
    the joins can be split where one node has many links.
    """
    spark = links.sparkSession
    edges, edge_path = stored(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges"
    )
    labels, path = stored(
        edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")),
        "labels",
    )
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
            F.min("label").alias("near")
        )
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = lower.selectExpr("node AS next", "next AS beyond")
        moved, new_path = stored(
            lower.join(jump, "next").select(
                "node", F.least("next", "beyond").alias("label"), F.col("label").alias("before")
            ),
            "labels",
        )
        drop_table(spark, path)
        labels, path = moved.select("node", "label"), new_path
        if moved.where("label <> before").isEmpty():
            drop_table(spark, edge_path)
            return labels.withColumnRenamed("label", "component")
