"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelake.staging import staged

#: The separators between words; a word is a longest run of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Number the rows of each key from 0, in an order fixed by the data, without one task per key.

    Rows of a key are spread over buckets by a hash of the order columns; a row's number is its
    place in the bucket plus the sizes of the key's earlier buckets. Bucket count follows the
    table's size, so that a bucket stays near ``rows_per_bucket`` whatever one key holds.
    """
    from pyspark.sql import Window as W

    n = df.count()
    spread = max(1, -(-n // rows_per_bucket))
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(spread)))
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(
        *keys, "_b", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_before")
    )
    place = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1
    left = df.withColumn(out, place)
    on = [left[k].eqNullSafe(before[k]) for k in [*keys, "_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(before, cond, "left").select(
        *[left[c] for c in df.columns if c != "_b"], (left[out] + before["_before"]).cast("long").alias(out)
    )


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, the row's number from 0 in the order of columns that tell all rows apart: ranges are
    numbered on their own and moved by the sizes of those before, a row a range."""
    from pyspark.sql import Window as W

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return cut.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(out, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
