"""Session helpers: a tuned local session, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest side (in rows) that is ever hinted as a broadcast.
BROADCAST_ROW_LIMIT = 200_000


def local_session(cores: int | str = 8, app: str = "millrace") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session without it gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
            folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so that lost executors do not lose the rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the row count, known to the caller, is under the limit.

    Above it the frame is returned as is and Spark joins by shuffle.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROW_LIMIT else df
