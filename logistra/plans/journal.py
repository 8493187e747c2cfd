"""A journal of finished steps, from which a broken-off training run goes on.

The journal is a folder that outlives the driver: a table of settings and one table
per finished step. A step counts once its table is committed; what a driver left of an
unfinished one is written anew. Training with the same journal reads the last finished
step and goes on behind it; a finished run is read back without touching the rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = "_settings"


class Journal:
    """Finished steps below ``path``."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        """A journal of other settings is refused: its steps are those of another run."""
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: hadoop(f"{self.path}/{name}")
        self._files = hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        text = json.dumps(settings, sort_keys=True)
        if self._committed(SETTINGS):
            found = spark.read.text(f"{self.path}/{SETTINGS}").first()[0]
            if found != text:
                raise ValueError(f"{path} is the journal of another run: {found}, not {text}")
        else:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
                f"{self.path}/{SETTINGS}"
            )

    def _committed(self, name: str) -> bool:
        return self._files.exists(self._at(f"{name}/_SUCCESS"))

    def finished(self) -> int:
        """The number of the last step that is committed; all before it are too."""
        step = 0
        while self._committed(f"iteration={step + 1}"):
            step += 1
        return step

    def write(self, step: int, table: DataFrame) -> DataFrame:
        """Commits a step and reads it back."""
        table.write.mode("overwrite").parquet(self.step_path(step))
        return self.read(step, table.schema)

    def read(self, step: int, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.step_path(step))

    def step_path(self, step: int) -> str:
        return f"{self.path}/iteration={step}"

    def history(self, last: int) -> DataFrame:
        """All steps up to ``last``, with ``iteration``."""
        steps = self.spark.read.option("basePath", self.path)
        return steps.parquet(*[self.step_path(step) for step in range(1, last + 1)])


def digest(table: DataFrame | None) -> str | None:
    """A number that tells tables of models apart, whatever the order of their rows."""
    if table is None:
        return None
    row = F.xxhash64(*[F.col(name) for name in sorted(table.columns)]).cast("decimal(38,0)")
    found = table.agg(F.count("*"), F.sum(row)).first()
    return f"{found[0]}:{found[1]}"
