"""Plan shape helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; Spark then knows how large it is."""
    path = f"{shared_dir(df.sparkSession)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def evaluated_once(df: DataFrame) -> DataFrame:
    """The same rows through an exploded one-element array.

    A later filter on a computed column then reads the finished column; without
    this the optimizer moves the filter below the projection and evaluates the
    whole expression a second time.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt over the shuffle partitions by `keys`, for work that is heavy per row.

    A table of few bytes a row is read in few tasks; after this the tasks follow the rows. The number is named, or adaptive
    execution would join the parts again by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
