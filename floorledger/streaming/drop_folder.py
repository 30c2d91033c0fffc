"""Drop folder: every arriving workbook is cleaned and replaces its months in the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from floorledger.operators.uploads import KEYS, latest_uploads, rows_of
from floorledger.plans.load import load_grid, stage_batch, work_folder
from floorledger.session import cut_lineage
from floorledger.sources.grid import WORKBOOK_GLOB, decode_workbooks, rejected_files
from floorledger.sources.history import write_history

FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
ERRORS_SCHEMA = "path string, error string, batch bigint"
# Longer than any file is old: a file that keeps an old time stamp is still new to the folder.
NEVER = "100000d"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Names of the files in ``folder`` that are numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return [int(n) for n in names if n.isdigit()]


def _interrupted(spark: SparkSession, checkpoint: str) -> int | None:
    """The last finished batch of a run that broke off inside a later one (-1: inside its first); else None."""
    begun, done = (_numbers(spark, f"{checkpoint}/{kind}") for kind in ("offsets", "commits"))
    last = max(done, default=-1)
    return last if max(begun, default=-1) > last else None


def read_errors(spark: SparkSession, root: str) -> DataFrame:
    """``path, error, batch`` of all uploads to the drop folder that could not be loaded."""
    return spark.read.schema(ERRORS_SCHEMA).parquet(f"{root.rstrip('/')}/load_errors")


def follow_folder(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    rollups: bool = False,
    staging: str | None = None,
) -> StreamingQuery:
    """Load what is new in ``folder``, with its subfolders, and stop; run it again, or on a schedule, for later arrivals.

    A later run replaces months of an earlier one. Within a run the upload with the latest modification
    time supplies a month, and of equal times the last path: the winners of a run are kept from batch to
    batch, so the outcome does not depend on the size of the batches. No file is too old to be loaded.
    There is no event-time state. A batch that is repeated after a failure replaces the same months with
    the same rows. Uploads that cannot be loaded are found with ``read_errors``; files that are no
    workbooks are listed there as of the start of the last run, as batch -1.
    """
    root = root.rstrip("/")
    errors, state = f"{root}/load_errors", f"{root}/_drop_folder/winners"
    last = _interrupted(spark, checkpoint)
    won = spark.read.parquet(f"{state}/{last}") if last is not None and last in _numbers(spark, state) else None
    rejected_files(spark, folder).write.mode("overwrite").parquet(f"{errors}/batch=-1")
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES_SCHEMA)
        .option("pathGlobFilter", WORKBOOK_GLOB)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", NEVER)
        .load(folder)
    )

    def load(batch: DataFrame, number: int) -> None:
        nonlocal won
        result = load_grid(decode_workbooks(batch), root, staging=staging, rollups=rollups, earlier=won)
        result.errors.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        winners = result.winners.select(*KEYS, "upload")
        if won is not None:
            winners = won.unionByName(winners).groupBy(*KEYS).agg(F.max("upload").alias("upload"))
        won = cut_lineage(winners)
        won.write.mode("overwrite").parquet(f"{state}/{number}")

    return (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow_batches(
    batches: DataFrame, root: str, checkpoint: str, upload: str = "upload_seq", staging: str | None = None
) -> StreamingQuery:
    """The same loop for a stream of canonical rows that carry an upload number; each batch is staged once."""

    def load(batch: DataFrame, _: int) -> None:
        staged = stage_batch(batch, f"{work_folder(batch.sparkSession, staging)}/batch")
        winners = latest_uploads(staged, upload)
        write_history(rows_of(staged, winners, upload), root)

    return (
        batches.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
