"""The search index, its queries, and what a search run returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelake.functions import names, paths
from cratelake.operators import ladders, select, similar, tags

#: Tag groups that have columns of their own.
HIDDEN_GROUPS = ("role", "origin")


def index(locations: DataFrame, origins: DataFrame, tag_rows: DataFrame, picks: DataFrame) -> DataFrame:
    """sample_id, path, role, origin, zone, tags, picks of every sample at its first path.

    ``locations`` is (sample_id, path), ``origins`` (sample_id, origin), ``tag_rows`` (sample_id, tag_group, tag), ``picks``
    (sample_id, picks); samples without an origin are ``unknown``, without a pick 0.
    """
    first = locations.groupBy("sample_id").agg(F.min("path").alias("path"))
    shown = tag_rows.filter(~F.col("tag_group").isin(*HIDDEN_GROUPS)).groupBy("sample_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    one = origins.groupBy("sample_id").agg(F.min("origin").alias("origin"))
    kept = picks.groupBy("sample_id").agg(F.sum("picks").alias("picks"))
    j = first.join(one, "sample_id", "left").join(shown, "sample_id", "left").join(kept, "sample_id", "left")
    p = F.col("path")
    return j.select(
        "sample_id", "path", ladders.role(p)["role"].alias("role"), F.coalesce("origin", F.lit("unknown")).alias("origin"), paths.zone(p).alias("zone"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("picks", F.lit(0)).cast("long").alias("picks"),
    )


def describe(terms: tuple[str, ...] = (), groups: dict[str, tuple[str, ...]] | None = None, curated_only: bool = False) -> str:
    """A query in words, kept with the picks and crates that it gave."""
    parts = [*terms, *[f"{g}={v}" for g, vs in (groups or {}).items() for v in vs], *(["zone=CURATED"] if curated_only else [])]
    return " ".join(parts) or "(all)"


def resolve(found: DataFrame, reference: str) -> DataFrame:
    """One row, sample_id: the sample of that id, else the only one whose path holds the reference. Reading it
    fails if there is none or more than one."""
    one = found.agg(
        F.max(F.when(F.col("sample_id").cast("string") == reference, F.col("sample_id"))).alias("_id"), F.min(F.when(F.contains("path", F.lit(reference)), F.col("sample_id"))).alias("_hit"),
        F.count_if(F.contains("path", F.lit(reference))).alias("_n"),
    )
    text = F.when(F.col("_n") == 0, F.lit(f"nothing in the index matches {reference!r}")).otherwise(F.concat(F.lit(f"{reference!r} matches "), F.col("_n").cast("string"), F.lit(" samples")))
    return one.select(F.when(F.col("_id").isNotNull(), F.col("_id")).when(F.col("_n") == 1, F.col("_hit")).otherwise(F.raise_error(text)).alias("sample_id"))


def run(found: DataFrame, order: str = "path", limit: int = 0, like: str | None = None, vectors: DataFrame | None = None, dims: int = 16) -> DataFrame:
    """The rows of a search (``tags.search`` of the index) with ``place``, their number in the order asked for, the
    first ``limit`` of them (0: all), and ``total``, how many were found.

    order: ``path``; ``picks``, the most picked first; ``spread``, round robin over the families of takes; ``like``,
    the nearest to one sample by ``vectors`` (sample_id, v), those that aren't measured left out.
    """
    total = found.agg(F.count("*").alias("total"))
    if order == "spread":
        ranked = found.withColumn("_family", names.family(F.col("path")))
        ranked = select.round_robin(ranked.withColumn("_all", F.lit(0)), ["path"], ["origin", "_family"], ["origin", "_family"], ["_all"], limit or None).drop("_all", "_family", "turn")
        return ranked.join(F.broadcast(total))
    if order == "like":
        v = vectors.select("sample_id", "v")
        target = resolve(found, like).join(v, "sample_id").select(F.col("v").alias("_t"))
        rows = found.join(v, "sample_id").join(F.broadcast(target)).join(F.broadcast(similar.ranges(vectors, "v", dims)))
        rows = rows.withColumn("distance", similar.distance(F.col("_t"), F.col("v"), F.col("low"), F.col("span"))).filter("distance IS NOT NULL").drop("_t", "v", "low", "span")
        keys = [F.col("distance"), F.col("path")]
    else:
        rows, keys = found, [F.desc("picks"), F.col("path")] if order == "picks" else [F.col("path")]
    if limit:
        rows = rows.orderBy(*keys).limit(limit)
    return select.global_place(rows, keys, "place").join(F.broadcast(total))


def regenerate(samples: DataFrame, rules: list, origins: DataFrame) -> DataFrame:
    """(sample_id, tag_group, tag, source): rule tags, and origin and role as tags, of samples (sample_id, path, role, origin,
    and measures)."""
    hits = tags.apply_rules(samples, rules).select("sample_id", "tag_group", "tag", F.lit("rule").alias("source"))
    known = origins.filter("origin <> 'unknown'").select("sample_id", F.lit("origin").alias("tag_group"), F.col("origin").alias("tag"), F.lit("rule").alias("source"))
    roles = samples.select("sample_id", F.lit("role").alias("tag_group"), F.lower("role").alias("tag"), F.lit("rule").alias("source"))
    return hits.unionByName(known).unionByName(roles).dropDuplicates(["sample_id", "tag_group", "tag"])
