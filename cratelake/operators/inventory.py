"""Runs that keep the inventory of a library from scan to scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelake.operators import catalog, gates
from cratelake.sources import files
from cratelake.state import State

LOCATIONS = "path string, sample_id string, size long, mtime_ms long, scan_id string, exists_now boolean"
SCANS = "scan_id string, root string, started_at string, status string, completed_at string, file_count long"
ASSETS = "sample_id string, size long, first_scan string"
PICKS = "sample_id string, kit string, query string, picked_at string"
TAGS = "sample_id string, tag_group string, tag string, source string"
PROMOTIONS = "sample_id string, curated_path string, source_path string, run_id string"
REVIEWS = "sample_id string, run_id string, decision string, true_role string, descriptor string, notes string"


def scan(spark: SparkSession, state_root: str, library: str, scan_id: str, started: str, completed: Callable[[], str]) -> State:
    """Scan a library into the state: locations, assets and the row of the scan.

    The scan's row is committed as incomplete before anything is read, and with all the rest as complete at the
    end, so that a run which breaks off leaves its row and changes nothing else; run again with its
    id, it starts over. Bytes are read of files only whose path, size and time the state doesn't know.
    """
    state = State(spark, state_root)
    others = state.read("scans", SCANS).filter(F.col("scan_id") != scan_id)
    none = spark.createDataFrame([], LOCATIONS)
    state = state.commit(scans=others.unionByName(catalog.scan_row(none, scan_id, library, started)))
    known = state.read("locations", LOCATIONS)
    cache = known.select("path", F.col("size").alias("length"), F.timestamp_millis("mtime_ms").alias("modificationTime"), "sample_id")
    found = files.content_ids(spark, library, cache)
    seen = found.select("path", "sample_id", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    locations = catalog.finish_scan(known, seen, scan_id)
    # the scan's bytes are read once: what follows reads what was written
    state = state.commit(pending=locations)
    locations = state.read("pending", LOCATIONS)
    now = locations.filter("exists_now")
    new = now.groupBy("sample_id").agg(F.min("size").alias("size")).withColumn("first_scan", F.lit(scan_id))
    assets = catalog.first_seen(state.read("assets", ASSETS), new, "sample_id")
    done = catalog.scan_row(now, scan_id, library, started, completed())
    return state.commit(locations=locations, assets=assets, scans=others.unionByName(done))


def current(state: State) -> DataFrame:
    """The locations of the latest complete scan."""
    latest = catalog.latest_complete(state.read("scans", SCANS)).select("scan_id")
    return state.read("locations", LOCATIONS).filter("exists_now").join(F.broadcast(latest), "scan_id")


def record_picks(state: State, picks: DataFrame) -> State:
    return state.commit(picks=catalog.upsert_picks(state.read("picks", PICKS), picks))


def record_tags(state: State, rows: DataFrame, source: str = "rule") -> State:
    """Tags of one source replaced, those of others kept."""
    return state.commit(tags=catalog.regenerate(state.read("tags", TAGS), rows, source))


def record_reviews(state: State, reviews: DataFrame) -> State:
    """Of each sample and run the latest review; what comes twice in one sheet is one, the least in the order of its columns."""
    return state.commit(reviews=catalog.upsert(state.read("reviews", REVIEWS), reviews, ["sample_id", "run_id"], ["decision", "true_role", "descriptor", "notes"]))


def record_promotions(state: State, rows: DataFrame) -> State:
    """Promotions are added only: the run fails, and nothing is added, if one is there or comes twice."""
    new, bad = catalog.insert_only(state.read("promotions", PROMOTIONS), rows, ["sample_id", "curated_path"])
    return state.commit(promotions=gates.strict(new, bad.withColumn("violation", F.lit("promotion exists"))))
