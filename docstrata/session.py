"""Session helpers: sensible local defaults and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks; on a cluster the submitted session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docstrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in `spark.checkpoint.dir`.

    Only a local session, which has no other machines, falls back to a new folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="run-")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the session's shared folder, so that lost executors lose nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
