"""Session construction and the few settings that operators need at run time."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "factloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FACTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where the session names none a temporary folder is set, but only on a single machine: on a
    cluster the executors wouldn't share it, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so that losing an executor loses no result."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
