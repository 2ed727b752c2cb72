"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def scores(df: DataFrame, domain: tuple) -> DataFrame:
    """Precision, recall, F1 and support of each class of the domain, 0 where undefined."""
    true = df.groupBy(F.col("truth").alias("role")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("predicted")).alias("tp"))
    pred = df.groupBy(F.col("predicted").alias("role")).agg(F.count("*").alias("named"))
    names = df.sparkSession.createDataFrame([(d,) for d in domain], "role string")
    z = lambda c: F.coalesce(c, F.lit(0))
    j = F.broadcast(names).join(true, "role", "left").join(pred, "role", "left").select("role", z("support").alias("support"), z("tp").alias("tp"), z("named").alias("named"))
    j = j.withColumn("precision", F.coalesce(F.try_divide("tp", "named"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))
    return j.select("role", "support", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"))
