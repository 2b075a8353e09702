"""Where intermediate tables go, and the size check before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

#: A side is broadcast only if it was counted and its rows, at `row_bytes` each, stay under this.
BROADCAST_BYTES = 32 << 20


#: Rows of an Arrow batch; Spark's own default is made for narrow rows, not for whole texts.
TEXTS_PER_BATCH = "1000"


def text_batches(spark: SparkSession) -> None:
    """Let whole texts travel to Python in smaller batches, unless the session already says how many rows it wants."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, TEXTS_PER_BATCH)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder: computed once, and readable whichever executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df (a stored table), marked for broadcasting if its counted rows allow; else the join shuffles as usual."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
