"""Null-tolerant similarity over measured features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranges(df: DataFrame, v: str, dims: int) -> DataFrame:
    """One row: the least value and the span of each dimension; a constant one has span 1."""
    low, high = [F.min(F.col(v)[i]) for i in range(dims)], [F.max(F.col(v)[i]) for i in range(dims)]
    one = df.agg(F.array(*low).alias("low"), F.array(*high).alias("high"))
    span = F.zip_with("high", "low", lambda h, x: F.when(h > x, h - x).otherwise(1.0))
    return one.select(F.transform("low", lambda x: F.coalesce(x, F.lit(0.0))).alias("low"), span.alias("span"))


def distance(a: Column, b: Column, low: Column, span: Column) -> Column:
    """Root mean square of the differences, scaled by the ranges, over dimensions both have."""
    scaled = lambda v: F.zip_with(F.zip_with(v, low, lambda x, y: x - y), span, lambda x, y: x / y)
    gaps = F.filter(F.zip_with(scaled(a), scaled(b), lambda x, y: (x - y) * (x - y)), lambda g: g.isNotNull())
    return F.when(F.size(gaps) > 0, F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) / F.size(gaps)))


def nearest(df: DataFrame, target: int, v: str, dims: int, n: int) -> DataFrame:
    """The rows nearest to one row, itself included. The target and the ranges are a row each; reading the result
    fails if there is no row of that id."""
    one = df.agg(F.max(F.when(F.col("sample_id") == target, F.struct(F.col(v).alias("v")))).alias("_t"))
    one = one.select(F.when(F.col("_t").isNull(), F.raise_error(F.lit(f"no measured features for {target}"))).otherwise(F.col("_t.v")).alias("_t"))
    j = df.join(F.broadcast(one)).join(F.broadcast(ranges(df, v, dims)))
    d = j.withColumn("distance", distance(F.col("_t"), F.col(v), F.col("low"), F.col("span"))).filter("distance IS NOT NULL")
    return d.orderBy("distance", "sample_id").limit(n).select("sample_id", "role", "distance")
