"""Reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a plan's shuffle files go when it has run; a plan takes it on when it is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint.

    The folder is ``spark.checkpoint.dir``; one is made only where that is unset and the master is local, as in tests.
    Shuffle files of the plan leave the disk at its end, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df = df.select("*")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables of a run's own, set for the session if it was not."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="chronofold-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
