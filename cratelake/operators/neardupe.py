"""Near duplicates among long loops: one row of a block is kept, the others are scored against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelake.functions import analysis, paths

# What a pair's likeness is made of, and the limits.
TERMS = (
    ("duration_s", 0.12, 0.25), ("tail_ms", 0.12, 80.0), ("sub_ratio", 0.16, None), ("low_ratio", 0.10, None), ("mid_ratio", 0.10, None),
    ("high_ratio", 0.10, None), ("centroid_hz", 0.14, 200.0), ("flatness", 0.06, None), ("onset_density", 0.05, 1.0), ("zcr", 0.05, None),
)
SUFFIX_RANK = {".wav": 0, ".aif": 1, ".aiff": 1, ".flac": 2, ".mp3": 3, ".ogg": 4}
LEAST_SECONDS, LEAST_SCORE, HIGH = 3.0, 0.99, 0.94


def canonical_key(path: Column) -> Column:
    """Curated first, then by format, depth, length and the path itself."""
    ranks = F.create_map(*[F.lit(x) for kv in SUFFIX_RANK.items() for x in kv])
    curated = F.when(F.get(paths.parts(path), F.lit(0)) == "CURATED", 0).otherwise(1)
    return F.struct(curated, F.coalesce(ranks[analysis.suffix(path)], F.lit(9)), F.size(paths.parts(path)), F.length(path), path)


def score(a: Column, b: Column) -> Column:
    """1 less the weighted differences of two rows' measures, between 0 and 1."""
    gaps = [F.lit(w) * (paths.ratio_distance(a[n], b[n], floor) if floor else F.abs(a[n] - b[n])) for n, w, floor in TERMS]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - sum(gaps[1:], gaps[0])))


def eligible() -> Column:
    return (F.col("sample_type") == "loop") & (F.col("duration_s") >= LEAST_SECONDS)


def groups(rows: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """group_id, role, sample_type, family, keep_path, path, score, confidence, reason of rows (path, role,
    sample_type, proposed_name, and the measures of ``TERMS``).

    Blocks are of one role, type and name family; the canonical row of a block is found by a partial
    aggregate and joined back, so a block of any size is scored in pieces. Rows that lack a measure,
    a role, a type or a family are left out; a repeated path counts once.
    """
    measures = [n for n, _, _ in TERMS]
    r = rows.withColumn("family", analysis.name_family(F.coalesce(F.nullif("proposed_name", F.lit("")), F.col("path"))))
    r = r.filter(eligible() & (F.col("family") != "") & (F.col("role") != "")).na.drop(subset=measures)
    r = r.select("role", "sample_type", "family", "path", F.struct(*measures).alias("_x")).dropDuplicates(["role", "sample_type", "family", "path"])
    block = ["role", "sample_type", "family"]
    keep = r.groupBy(*block).agg(F.min_by(F.struct("path", "_x"), canonical_key(F.col("path"))).alias("_keep"))
    j = r.join(keep, block).filter(F.col("path") != F.col("_keep.path")).withColumn("score", score(F.col("_keep._x"), F.col("_x"))).filter(F.col("score") >= least)
    return j.select(
        F.concat_ws(":", *block).alias("group_id"), *block, F.col("_keep.path").alias("keep_path"), "path", "score",
        F.when(F.col("score") >= HIGH, "high").otherwise("medium").alias("confidence"), analysis.dup_reason(F.col("score")).alias("reason"),
    )


def select_groups(found: DataFrame, family: str | None = None, limit: int | None = None) -> DataFrame:
    """Groups whose family holds a name's, the first ``limit`` of them in order."""
    if family:
        needle = found.sparkSession.range(1).select(analysis.name_family(F.lit(family)).alias("_n"))
        found = found.join(F.broadcast(needle)).filter(F.contains("family", F.col("_n"))).drop("_n")
    if limit is not None:
        first = found.select("role", "sample_type", "family").distinct().orderBy("role", "sample_type", "family").limit(max(0, limit))
        found = found.join(first, ["role", "sample_type", "family"], "left_semi")
    return found


def interleaved(found: DataFrame) -> DataFrame:
    """Rows of an audition list, (seq, path): each kept path before the one it is compared with."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("keep_path").alias("path")), F.struct(F.lit(1).alias("n"), F.col("path").alias("path"))))
    rows = found.select("group_id", F.col("path").alias("_with"), both.alias("x"))
    return rows.select(F.struct("group_id", "_with", "x.n").alias("seq"), "x.path")


def approved(decisions: DataFrame) -> DataFrame:
    """The rows whose decision is to remove."""
    return decisions.filter(F.lower(F.trim("decision")) == "remove")
