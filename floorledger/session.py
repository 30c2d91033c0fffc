"""Session helpers: settings the library relies on and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A whole workbook travels as one binary cell; bound the Arrow batch by bytes, not by 10,000 files.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("floorledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster that folder would be
    private to one machine, so an unset value is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if named:
        if not active:
            context.setCheckpointDir(named)
        return named
    if active:
        return active
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set; name a folder all executors share")
    folder = tempfile.mkdtemp(prefix="floorledger-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: what ``cut_lineage`` does, for large frames.

    Parquet is smaller than a checkpoint's rows, and later steps read only the columns they need.
    """
    folder = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
