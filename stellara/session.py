"""Shared folder, lineage cuts and file removal."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: whether Spark deletes a query's shuffle files when it is over, and not when the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share. Where it is unset, a session on one machine gets a folder of its own;
    on a cluster that would be a local one, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="stellara-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: what comes after reads files, whatever executors are lost. What was shuffled for it is deleted."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: df, if read again, has its shuffles still
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, wherever Spark can reach it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
