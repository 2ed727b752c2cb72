"""Curation: checks of a label sheet against the library, promotions, and the views that consumers read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelake.functions import analysis, paths
from cratelake.operators import gates, tags
from cratelake.operators.vocabulary import QUOTAS

ONE_SHOTS = tuple(r for r in QUOTAS if r not in ("DRUM-LOOP", "BASS-LOOP", "SYNTH-LOOP", "VOCAL-LOOP", "TEXTURE-DRONE"))


def freshness(packet: DataFrame, latest: DataFrame) -> DataFrame:
    """(row, violation) if a packet (scan_id, root) wasn't made from the latest complete scan (scan_id, root)."""
    j = packet.select(F.col("scan_id").alias("_a"), F.col("root").alias("_r")).join(latest, F.lit(True), "left")
    bad = F.array_compact(F.array(F.when(~F.col("_a").eqNullSafe(F.col("scan_id")), "stale packet: a newer scan exists"), F.when(~F.col("_r").eqNullSafe(F.col("root")), "stale packet: another root")))
    return j.select(F.lit(None).cast("long").alias("row"), F.explode(bad).alias("violation"))


def stale(labels: DataFrame, locations: DataFrame, current: DataFrame) -> DataFrame:
    """(row, violation) of labels (row, sample_id, current_path) whose path isn't in the scan with that id, or whose bytes
    are others now. ``locations`` and ``current`` are (path, sample_id)."""
    a, b = locations.select(F.col("path").alias("current_path"), F.col("sample_id").alias("_scan")), current.select(F.col("path").alias("current_path"), F.col("sample_id").alias("_now"))
    j = labels.join(a, "current_path", "left").join(b, "current_path", "left")
    gone = ~F.col("_scan").eqNullSafe(F.col("sample_id"))
    fault = F.when(gone, "stale or missing source").when(~F.col("_now").eqNullSafe(F.col("sample_id")), "hash changed since the scan")
    return j.select(F.col("row").cast("long").alias("row"), fault.alias("violation")).filter("violation IS NOT NULL")


def promotions(labels: DataFrame, locations: DataFrame) -> DataFrame:
    """(row, sample_id, source, curated_path) of the favourites: role, descriptor, source and id make the name."""
    loc = locations.select(F.col("path").alias("current_path"), analysis.source_name(F.col("path")).alias("_source"))
    parts = [paths.normalise_token(F.col(c)) for c in ("true_role", "descriptor", "_source")]
    name = F.concat(F.concat_ws("_", *parts, F.substring("sample_id", 1, 8)), analysis.suffix(F.col("current_path")))
    f = labels.filter("decision = 'favourite'").join(loc, "current_path")
    return f.select("row", "sample_id", F.col("current_path").alias("source"), F.concat_ws("/", F.lit("CURATED"), "true_role", name).alias("curated_path"))


def collisions(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(row, violation) of promotions whose destination is there."""
    hit = plan.join(files.select(F.col("path").alias("curated_path")).distinct(), "curated_path", "left_semi")
    return hit.select(F.col("row").cast("long").alias("row"), F.lit("curated destination exists").alias("violation"))


def promote(labels: DataFrame, packet: DataFrame, latest: DataFrame, locations: DataFrame, current: DataFrame, must: bool = False) -> tuple[DataFrame, DataFrame]:
    """The promotions of a label sheet, and everything that stands in their way: nothing is promoted unless that is empty;
    with ``must`` the promotions can't be read then."""
    plan = promotions(labels, locations)
    rules = tags.label_violations(labels, tuple(QUOTAS)).select(F.col("row").cast("long").alias("row"), "violation")
    faults = freshness(packet, latest).unionByName(rules).unionByName(stale(labels, locations, current)).unionByName(collisions(plan, current))
    return gates.strict(plan, faults) if must else plan, faults


def consumer_views(labels: DataFrame, promoted: DataFrame, quotas: dict[str, int] = QUOTAS, must: bool = False) -> tuple[DataFrame, DataFrame]:
    """Crate rows (crate, sample_id, source_path, role, descriptor, reason) of the favourites, all and the one-shots; and
    violations: roles short of their quota, favourites that aren't promoted (sample_id, curated_path)."""
    f = labels.filter("decision = 'favourite'")
    where = promoted.groupBy("sample_id").agg(F.min("curated_path").alias("source_path"))
    rows = f.join(where, "sample_id", "left")
    crate = rows.filter("source_path IS NOT NULL").select(F.explode(F.array(F.lit("foundation-v1-all"), F.when(F.col("true_role").isin(*ONE_SHOTS), "foundation-v1-one-shots"))).alias("crate"), "sample_id", "source_path", F.col("true_role").alias("role"), "descriptor", F.col("tags").alias("reason"))
    need = labels.sparkSession.createDataFrame(list(quotas.items()), "role string, quota long")
    have = f.groupBy(F.col("true_role").alias("role")).agg(F.count("*").alias("n"))
    short = F.broadcast(need).join(have, "role", "left").filter(F.coalesce("n", F.lit(0)) < F.col("quota"))
    short = short.select(F.lit(None).cast("long").alias("row"), F.concat(F.lit("quota shortage: "), F.col("role"), F.lit(" "), F.coalesce("n", F.lit(0)).cast("string")).alias("violation"))
    bare = rows.filter("source_path IS NULL").select(F.col("row").cast("long").alias("row"), F.lit("favourite has not been promoted").alias("violation"))
    crate, faults = crate.filter("crate IS NOT NULL"), short.unionByName(bare)
    return gates.strict(crate, faults) if must else crate, faults


def undo(plan: DataFrame) -> DataFrame:
    """What takes the promotions back: the copies to remove."""
    return plan.select(F.col("curated_path").alias("path"), "sample_id")
