"""Benchmark packets and their scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelake.functions import analysis, paths
from cratelake.operators import evaluate, select

# Roles that are scored, and the packets' size.
SCORED = ("KICKS", "CLAP-SNARE", "HATS-CYM", "PERC", "DRONE-ATMOS", "VOCALS", "OTHER")
SIZE, BUCKETS, MOST_SECONDS = 25, 5, 2.5


def items(files: DataFrame, features: DataFrame, role: str, most_seconds: float | None = None) -> DataFrame:
    """sample_id, path, folder_role, centroid_hz, sub_ratio, duration_s of the audio in a role's curated folder. Files
    without features stay; with a cap, those that are longer or of unknown length go."""
    p = F.col("path")
    kept = (analysis.curated_role(p) == role) & analysis.suffix(p).isin(*analysis.AUDIO_EXTS) & ~F.element_at(paths.parts(p), -1).startswith("._")
    rows = files.filter(kept).select("path").join(features.select("path", "centroid_hz", "sub_ratio", "duration_s"), "path", "left")
    if most_seconds is not None:
        rows = rows.filter(F.col("duration_s") <= most_seconds)
    return rows.select(paths.short_id(p).alias("sample_id"), "path", F.lit(role).alias("folder_role"), "centroid_hz", "sub_ratio", "duration_s")


def packet(rows: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """About ``size`` items of each role, spread over the centroid's quantiles and over packs."""
    return select.stratified(rows, "centroid_hz", F.coalesce(F.get(paths.parts(F.col("path")), F.lit(2)), F.lit("")), ["folder_role"], size, buckets)


def label_violations(labels: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    """(path, violation) of labels (path, true_role) that are blank or of no known role."""
    role = F.trim(F.coalesce("true_role", F.lit("")))
    fault = F.when(role == "", "unlabelled row").when(~role.isin(*domain), "invalid true_role")
    return labels.select("path", fault.alias("violation")).filter("violation IS NOT NULL")


def truth(labels: DataFrame, predictions: DataFrame, domain: tuple[str, ...] = SCORED) -> DataFrame:
    """(path, truth, predicted) of labels (path, true_role) and predictions (path, predicted): what is missing or of no scored
    role is ``OTHER`` on both sides."""
    known = lambda c: F.when(F.col(c).isin(*domain), F.col(c)).otherwise("OTHER")
    return labels.join(predictions, "path", "left").select("path", known("true_role").alias("truth"), known("predicted").alias("predicted"))


def scorecard(pairs: DataFrame, domain: tuple[str, ...] = SCORED) -> DataFrame:
    """role, support, precision, recall, f1 of each scored role in order (place), with the overall accuracy and total in each row."""
    whole = pairs.agg(F.count("*").alias("total"), F.coalesce(F.try_divide(F.count_if(F.col("truth") == F.col("predicted")), F.count("*")), F.lit(0.0)).alias("accuracy"))
    place = F.array_position(F.array(*map(F.lit, domain)), F.col("role"))
    return evaluate.scores(pairs, domain).withColumn("place", place).join(F.broadcast(whole))
