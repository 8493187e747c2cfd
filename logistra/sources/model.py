"""Models as parquet tables, one partition per iteration, in versions.

A stored model is a folder of versions. Each is written whole beside the others, and
then an empty pointer file, whose name has the next number and the version, is created,
which is one step on every file system. Readers take the pointer of the highest number,
so they see the old model or the new one and never none or half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "_pointers"
# Versions that stay after a save: the new one, and the last for those who are reading it.
KEPT_VERSIONS = 2


class _Store:
    """The files of one model."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self.files.makeQualified(self.path(path)).toString().rstrip("/")

    def at(self, *names: str):
        return self.path("/".join([self.root, *names]))

    def names(self, *folder: str) -> list[str]:
        """Names in a folder, sorted; none where there is no folder."""
        if not self.files.exists(self.at(*folder)):
            return []
        return sorted(entry.getPath().getName() for entry in self.files.listStatus(self.at(*folder)))

    def current(self) -> str:
        """The folder of the version that readers see."""
        pointers = self.names(POINTERS)
        if not pointers:
            # A model without pointers is a plain table.
            return self.root
        return self.at(pointers[-1].split("-", 1)[1]).toString()

    def point_to(self, version: str) -> None:
        self.files.mkdirs(self.at(POINTERS))
        pointers = self.names(POINTERS)
        number = int(pointers[-1].split("-", 1)[0]) + 1 if pointers else 1
        if not self.files.createNewFile(self.at(POINTERS, f"{number:012}-{version}")):
            raise OSError(f"cannot point to {version}")

    def sweep(self) -> None:
        """Deletes versions that are no longer pointed to, the pointer after its version.

        What is left of a sweep that breaks off is swept by the next. Versions that are
        being written have no pointer and stay.
        """
        for pointer in self.names(POINTERS)[:-KEPT_VERSIONS]:
            self.files.delete(self.at(pointer.split("-", 1)[1]), True)
            self.files.delete(self.at(POINTERS, pointer), False)
        for name in self.names():
            if name.startswith("iteration="):
                self.files.delete(self.at(name), True)


def save_model(model: DataFrame, path: str) -> None:
    """Write ``(iteration, .., i, w)`` as the whole content of ``path``.

    A model without ``iteration`` is stored as iteration 0. What was stored is
    replaced in one step once the new version is written; a failed write leaves
    it as it was. ``model`` may be read from ``path`` itself. Of two saves at
    the same time one becomes the last version. A reader that began before a save can finish, as the
    last KEPT_VERSIONS versions stay.
    """
    store = _Store(model.sparkSession, path)
    if "iteration" not in model.columns:
        model = model.withColumn("iteration", F.lit(0))
    version = f"version-{uuid.uuid4().hex}"
    try:
        model.write.partitionBy("iteration").parquet(store.at(version).toString())
    except BaseException:
        store.files.delete(store.at(version), True)
        raise
    store.point_to(version)
    store.sweep()


def load_model(spark: SparkSession, path: str, iteration: int | None = None) -> DataFrame:
    """The model of one iteration, by default the last one stored."""
    model = load_history(spark, path)
    if iteration is None:
        iteration = model.agg(F.max("iteration")).first()[0]
    return model.filter(F.col("iteration") == iteration).drop("iteration")


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The models of all iterations, as stored when this is called."""
    return spark.read.parquet(_Store(spark, path).current())
