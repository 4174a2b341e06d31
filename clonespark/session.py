"""Session defaults and the one place that knows where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "clonespark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here is tested under.

    Shuffle width is left to adaptive execution: the initial partition number is
    set high and small partitions are coalesced at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, taken from the session where it is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        configured = tempfile.mkdtemp(prefix="clonespark-checkpoint-")  # one machine, nothing else to share with
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    Used between the rounds of iterative operators. Unlike a local checkpoint the
    files outlive any executor, so losing one costs a re-read and not the job.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    Unlike a checkpoint the table is written by one job, compressed, and readers see single columns. It
    outlives any executor. The folder is the session's; whoever owns it clears it.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task writes at least, where few rows are left of a table.
PART = 4096


def narrowed(df: DataFrame, rows: int, part: int = PART) -> DataFrame:
    """``df`` in as many partitions as ``rows`` rows need, at most as many as it has.

    ``rows`` are those that the step reads or returns. A table of some thousand rows is not worth hundreds of
    tasks and files, which take longer than the rows; a table of many rows keeps its partitions.
    """
    return df.coalesce(max(1, -(-rows // part)))


def default_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(os.environ.get("CLONESPARK_MIN_PARTITIONS", "1")))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (a zip sent once per session)."""
    context = spark.sparkContext
    if getattr(context, "_clonespark_shipped", False):
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="clonespark-"), "clonespark"), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._clonespark_shipped = True
