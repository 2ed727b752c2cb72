"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where it is unset, a session in one process, as in
    tests, gets a fresh temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame, name: str, codec: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage and plan end here, on storage that
    outlives executors, and later reads prune columns. ``codec`` compresses it, else the session's.

    ``group_bytes`` ends a row group at so many bytes, looked at after each row: else rows are not looked at
    before the hundredth, and a task that writes or reads rows of megabytes holds a hundred of them."""
    path = f"{shared_dir(df.sparkSession)}/cratelake-{name}-{uuid.uuid4().hex}"
    groups = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(**groups).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
