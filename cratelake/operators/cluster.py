"""Deterministic k-means inside each role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelake.staging import staged

ROUNDS = 25
CENTROIDS = "role string, k int, centroids array<array<double>>"


def standardised(df: DataFrame, v: str, dims: int) -> DataFrame:
    """role, path, z: rows with every dimension, scaled by their role's mean and population deviation."""
    rows = df.filter(~F.exists(v, lambda x: x.isNull())).select("role", "path", v)
    stats = rows.groupBy("role").agg(F.array(*[F.avg(F.col(v)[i]) for i in range(dims)]).alias("_m"), F.array(*[F.stddev_pop(F.col(v)[i]) for i in range(dims)]).alias("_s"))
    less = F.zip_with(v, "_m", lambda x, m: x - m)
    return rows.join(stats, "role").select("role", "path", F.zip_with(less, "_s", lambda x, s: x / F.when(s == 0, 1.0).otherwise(s)).alias("z"))


def _gaps():
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with("z", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, g: s + g))
    return F.transform("centroids", gap)


def cluster(df: DataFrame, v: str, dims: int) -> DataFrame:
    """role, path, cluster, distance, representative.

    One cluster where a role has fewer than 4 rows, else n // 30 of at least 2 and at most 8. It
    begins with the first path and then the row farthest from those chosen, the first path among
    equals. A lone cluster keeps its first row as centroid; an empty one keeps its centroid.
    What reaches the driver are at most 8 centroids a role, roles being a closed vocabulary. The
    scaled rows are staged: up to 32 rounds read them.
    """
    spark, z = df.sparkSession, staged(standardised(df, v, dims), "scaled")
    start = z.groupBy("role").agg(F.count("*").alias("n"), F.min_by("z", "path").alias("z"), F.min("path").alias("path")).collect()
    k = {r.role: 1 if r.n < 4 else min(8, max(2, r.n // 30)) for r in start}
    chosen, names = {r.role: [r.z] for r in start}, {r.role: [r.path] for r in start}
    while short := {role for role in k if len(chosen[role]) < k[role]}:
        now = spark.createDataFrame([(r, k[r], chosen[r], names[r]) for r in short], CENTROIDS + ", names array<string>")
        far = z.join(now, "role").filter(~F.array_contains("names", F.col("path")))
        for r in far.groupBy("role").agg(F.min_by(F.struct("z", "path"), F.struct(-F.array_min(_gaps()), "path")).alias("far")).collect():
            chosen[r.role].append(r.far.z)
            names[r.role].append(r.far.path)
    moving = {role for role in k if k[role] > 1}
    used = dict(chosen)
    for _ in range(ROUNDS):
        if not moving:
            break
        labels = _assign(z, spark.createDataFrame([(r, k[r], chosen[r]) for r in moving], CENTROIDS))
        means = labels.groupBy("role", "cluster").agg(F.array(*[F.avg(F.col("z")[i]) for i in range(dims)]).alias("c")).collect()
        new = {r: list(chosen[r]) for r in moving}
        for m in means:
            new[m.role][m.cluster] = m.c
        for role in list(moving):
            used[role] = chosen[role]
            if max(abs(a - b) for x, y in zip(new[role], chosen[role], strict=True) for a, b in zip(x, y, strict=True)) <= 1e-12:
                moving.discard(role)
            chosen[role] = new[role]
    final = spark.createDataFrame([(r, k[r], used[r]) for r in k], CENTROIDS)
    out = _assign(z, final)
    best = out.groupBy("role", "cluster").agg(F.min_by("path", F.struct("distance", "path")).alias("_best"))
    return out.join(best, ["role", "cluster"]).select("role", "path", "cluster", "distance", (F.col("path") == F.col("_best")).alias("representative"))


def _assign(z: DataFrame, centroids: DataFrame) -> DataFrame:
    j = z.join(centroids, "role").withColumn("_gaps", _gaps())
    return j.select("role", "path", "z", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int").alias("cluster"), F.array_min("_gaps").alias("distance"))
