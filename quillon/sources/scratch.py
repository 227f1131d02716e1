"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir or the session's checkpoint folder. Where neither is set, a
    temporary folder of this machine if all executors run on it, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quillon-")
    context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read again."""
    for table in tables:
        if path := getattr(table, "scratch_path", None):
            delete(table.sparkSession, path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    found, system = file_system(spark, path)
    system.delete(found, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. Few files of one row group each would be read by as few tasks; a table of more partitions than
    the session's parallelism is left as it is, so nothing large is shuffled for it."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df._jdf.rdd().getNumPartitions() < wanted else df
