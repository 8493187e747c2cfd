"""The shared folder for tables that must outlive the executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a
    cluster session fails, because executors do not share such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="logistra-"))
    return context.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/logistra/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and its path; ``options`` are the writer's."""
    path = new_table_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``new_table_path`` named; other paths are refused."""
    if not path.startswith(f"{shared_dir(spark).rstrip('/')}/logistra/"):
        raise ValueError(f"{path} is no table of the shared folder")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
