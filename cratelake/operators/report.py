"""An analysis run: feature rows, gates, cluster labels, crates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratelake.functions import analysis, names, paths
from cratelake.operators import cluster, ladders, select, tags
from cratelake.staging import staged

# Measures of the clusters, and the crates' quotas.
CLUSTER_MEASURES = ("duration_s", "rms", "crest", "attack_ms", "tail_ms", "centroid_hz", "flatness", "sub_ratio", "low_ratio", "mid_ratio", "high_ratio", "onset_density", "zcr")
KIT_32 = {"KICKS": 8, "CLAP-SNARE": 6, "HATS-CYM": 10, "PERC": 8}
DRUMS_64 = {"KICKS": 12, "CLAP-SNARE": 12, "HATS-CYM": 20, "PERC": 20}
FAVOURITES_96 = {
    "DRUM-LOOPS": 18, "DRONE-ATMOS": 18, "SYNTH-STAB-CHORD": 18, "BASS": 14, "FX-RISE-IMPACT": 12, "VOCALS": 8, "PERC": 4, "HATS-CYM": 2, "CLAP-SNARE": 1, "KICKS": 1,
}
SET_16 = {"KICKS": 4, "CLAP-SNARE": 4, "HATS-CYM": 4, "PERC": 4}
BED_64 = {"DRUM-LOOPS": 18, "DRONE-ATMOS": 18, "SYNTH-STAB-CHORD": 14, "FX-RISE-IMPACT": 14}
GATES = ("likely_kick", "review", "reject_as_kick")


def feature_rows(sources: DataFrame, measures: DataFrame) -> DataFrame:
    """Sources (path, source_kind, source_name, processing_tag, processing_reason) that are samples, with role, type, tempo, key, their
    measures (path, 16 of them, audio_error), character tags, role conflict and gate. It is written to the shared
    folder: the steps after it read it often."""
    p = F.col("path")
    r = sources.filter(analysis.is_sample(F.col("source_kind"))).join(measures, "path", "left")
    r = r.withColumn("duration", F.col("duration_s")).withColumn("role", F.coalesce(analysis.curated_role(p), ladders.role(p)["role"]))
    r = r.withColumns({"sample_type": names.sample_type(p, F.col("role")), "bpm": F.coalesce(paths.bpm(p), F.lit("")), "key": F.coalesce(names.musical_key(paths.stem(p)), F.lit(""))})
    r = r.withColumn("_t", analysis.character_tags()).withColumns({"character_tags": F.col("_t.tags"), "tag_reasons": F.col("_t.reasons")}).drop("_t")
    r = r.withColumn("conflict", analysis.role_conflict(p, F.col("sample_type"), F.col("duration"), F.col("tail_ms")))
    r = staged(r, "features")
    return staged(tags.kick_gate(r.withColumn("issues", F.col("conflict.issues"))).drop("issues"), "gates")


def gate_audit(rows: DataFrame) -> DataFrame:
    """path, gate, confidence, reasons, action of what is, or lies in the folder of, a kick."""
    scope = (F.col("role") == "KICKS") | (F.coalesce(analysis.curated_role(F.col("path")), F.col("role")) == "KICKS")
    return rows.filter(scope).select("path", "gate", "confidence", "reasons", F.col("gate_action").alias("action"))


def cluster_report(rows: DataFrame) -> DataFrame:
    """path, role, cluster_label, distance, representative: k-means within each role over rows fit for it.

    A label is the two most frequent character tags of a cluster, the first seen first among equals, or traits of its means;
    a role's repeats of a label are numbered from 2 in the order of clusters.
    """
    fit = rows.filter(analysis.cluster_candidate() & (F.coalesce("audio_error", F.lit("")) == ""))
    fit = staged(fit, "fit")
    got = cluster.cluster(fit.select("role", "path", F.array(*[F.col(m).cast("double") for m in CLUSTER_MEASURES]).alias("v")), "v", len(CLUSTER_MEASURES))
    j = got.join(fit.select("role", "path", "character_tags", "duration", *[m for m in CLUSTER_MEASURES]), ["role", "path"])
    by = ["role", "cluster"]
    base = labels(j, by)
    numbered = base.withColumn("_n", F.row_number().over(Window.partitionBy("role", "_base").orderBy("cluster")))
    label = F.when(F.col("_n") > 1, F.concat_ws("-", "_base", F.col("_n").cast("string"))).otherwise(F.col("_base"))
    return staged(got.join(numbered.select(*by, label.alias("cluster_label")), by).select("path", "role", "cluster_label", "distance", "representative"), "clusters")


def labels(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and _base: the label of each group before repeats are numbered."""
    each = rows.select(*by, "path", F.posexplode(F.filter(F.split("character_tags", ";"), lambda t: t != "")).alias("_pos", "tag"))
    ranked = each.groupBy(*by, "tag").agg(F.count("*").alias("_n"), F.min(F.struct("path", "_pos")).alias("_seen"))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_seen", "tag"))).filter("_rank <= 2")
    named = ranked.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "tag"))), lambda x: x["tag"]), "-").alias("_tags"))
    means = rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("sub_ratio", "centroid_hz", "flatness", "tail_ms", "onset_density", "duration")])
    traits = analysis.acoustic_label(*[F.col(c) for c in ("sub_ratio", "centroid_hz", "flatness", "tail_ms", "onset_density", "duration")])
    return means.join(named, by, "left").select(*by, F.coalesce("_tags", traits).alias("_base"))


def crates(rows: DataFrame, clusters: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """(crate, place, path, reason): four crates of fixed quotas, spread over clusters or folders, and one for each set."""
    r = rows.withColumn("_family", analysis.crate_family(F.col("path"), F.col("source_kind"), F.col("source_name")))
    if clusters is not None:
        r = r.join(clusters.select("path", "cluster_label"), "path", "left").withColumn("_family", F.when(F.col("cluster_label").isNotNull(), F.concat_ws("/", "role", "cluster_label")).otherwise(F.col("_family")))
    r = r.withColumn("_why", analysis.crate_reason(F.col("role"), F.col("sample_type"), F.col("character_tags")))
    one, any_, device = (r.filter(t) for t in (analysis.device_one_shot(), analysis.audition_candidate(), analysis.device_candidate()))
    fill = lambda df, quotas, most, wide: select.quota_fill(df.select("path", "role", "_family", "_why"), quotas, ["_family"], most, wide)
    named = lambda df, name, plus=0: df.select(F.lit(name).alias("crate"), (F.col("place") + plus).alias("place"), "path", F.col("_why").alias("reason"))
    pool = staged(fill(device.filter("source_kind = 'octatrack-set-audio'"), SET_16, 16, True), "pool")
    rest = fill(device.join(pool.select("path"), "path", "left_anti"), BED_64, 64, True)
    taken = pool.agg(F.count("*").alias("_n"))
    bed = rest.join(F.broadcast(taken)).filter(F.col("place") + F.col("_n") <= 64).withColumn("place", F.col("place") + F.col("_n"))
    out = named(fill(one, KIT_32, 32, False), "digitakt/punchy-techno-kit.txt").unionByName(named(fill(one, DRUMS_64, 64, False), "tr8s/909-plus-weird-perc.txt"))
    out = out.unionByName(named(fill(any_, FAVOURITES_96, 96, True), "ableton/dub-techno-favourites.txt"))
    out = out.unionByName(named(pool, "octatrack/dub-loop-bed-132.txt")).unionByName(named(bed, "octatrack/dub-loop-bed-132.txt"))
    if sets is not None:
        name = F.concat(F.lit("octatrack/"), paths.normalise_token(F.col("set_name")), F.lit("-set.txt"))
        out = out.unionByName(sets.select(name.alias("crate"), F.lit(1).alias("place"), F.col("set_root").alias("path"), F.lit("install-as-set;preserve-set").alias("reason")))
    return out


def counts(rows: DataFrame, clusters: DataFrame, crate_rows: DataFrame) -> DataFrame:
    """(section, name, n) of a run's report: kinds, roles, crates, clusters, issues, and the gate's outcomes with those that are 0."""
    some = lambda df, section, col: df.groupBy(F.lit(section).alias("section"), col.alias("name")).agg(F.count("*").alias("n"))
    issues = rows.filter("conflict IS NOT NULL").select(F.explode(F.split("conflict.issues", ";")).alias("i"))
    out = some(rows, "kind", F.col("source_kind")).unionByName(some(rows, "role", F.col("role"))).unionByName(some(crate_rows, "crate", F.col("crate")))
    out = out.unionByName(some(clusters, "cluster", F.concat_ws("/", "role", "cluster_label"))).unionByName(some(issues, "issue", F.col("i")))
    gates = rows.sparkSession.createDataFrame([(g,) for g in GATES], "name string")
    kicks = rows.filter("role = 'KICKS'").groupBy(F.col("gate").alias("name")).agg(F.count("*").alias("n"))
    return out.unionByName(F.broadcast(gates).join(kicks, "name", "left").select(F.lit("gate").alias("section"), "name", F.coalesce("n", F.lit(0)).alias("n")))
