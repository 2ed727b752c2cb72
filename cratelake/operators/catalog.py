"""Versioned inventory: snapshot merge, drift, ledgers, keyed upserts, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelake.operators import gates
from cratelake.operators.select import first_per_key


def snapshot_merge(state: DataFrame, scan: DataFrame) -> DataFrame:
    """Locations after a scan (path, version): seen paths exist with the scan's version, unseen ones
    keep theirs and stop existing."""
    s, n = state.select("path", F.col("version").alias("_old")), scan.select("path", F.col("version").alias("_new"), F.lit(True).alias("_seen"))
    j = s.join(n, "path", "full_outer")
    return j.select("path", F.when(F.col("_seen"), F.col("_new")).otherwise(F.col("_old")).alias("version"), F.coalesce("_seen", F.lit(False)).alias("exists_now"))


def drift(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    a, b = previous.select(key).distinct(), current.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("previous-only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("current-only")))


def upsert(state: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The state with the incoming rows in place of those of their keys; of rows with one key the first in order."""
    newest = first_per_key(incoming, keys, order)
    return newest.unionByName(state.join(newest.select(*keys), keys, "left_anti"))


def ancestors(df: DataFrame, path: str, out: str) -> DataFrame:
    """A row for each proper ancestor folder of a path."""
    p = F.split(path, "/")
    return df.withColumn(out, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, 1, i), "/"))))


def cascading(items: DataFrame, legacy: DataFrame) -> DataFrame:
    """Looks up items (size, mtime_ms, name) by all three, else by size and time where all rows of the
    pair agree on the payload; the rest is to be measured."""
    exact = legacy.groupBy("size", "mtime_ms", "name").agg(F.min("payload").alias("_exact"))
    pair = legacy.groupBy("size", "mtime_ms").agg(F.min("payload").alias("_lo"), F.max("payload").alias("_hi")).filter("_lo = _hi").select("size", "mtime_ms", F.col("_lo").alias("_pair"))
    j = items.join(exact, ["size", "mtime_ms", "name"], "left").join(pair, ["size", "mtime_ms"], "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_pair").isNotNull(), "pair").otherwise("measure")
    return j.select(*items.columns, F.coalesce("_exact", "_pair").alias("payload"), how.alias("status"))


def finish_scan(locations: DataFrame, scan: DataFrame, scan_id: str) -> DataFrame:
    """Locations (path, sample_id, size, mtime_ms, scan_id, exists_now) after a scan (path, sample_id, size, mtime_ms): seen paths
    take its values and number, unseen ones keep theirs and stop existing. Nothing is forgotten."""
    seen = scan.dropDuplicates(["path"]).select("path", "sample_id", "size", "mtime_ms", F.lit(scan_id).alias("scan_id"), F.lit(True).alias("exists_now"))
    gone = locations.join(seen.select("path"), "path", "left_anti").withColumn("exists_now", F.lit(False))
    return seen.unionByName(gone.select(*seen.columns))


def scan_row(scan: DataFrame, scan_id: str, root: str, started: str, completed: str | None = None) -> DataFrame:
    """The row of a scan (scan_id, root, started_at, status, completed_at, file_count). It is written as complete after all else,
    so that a scan which breaks off stays incomplete and isn't the latest one."""
    status = "complete" if completed else "incomplete"
    base = scan.agg(F.count("*").alias("file_count"))
    c = lambda v, n: F.lit(v).cast("string").alias(n)
    return base.select(c(scan_id, "scan_id"), c(root, "root"), c(started, "started_at"), c(status, "status"), c(completed, "completed_at"), "file_count")


def latest_complete(scans: DataFrame) -> DataFrame:
    return scans.filter("status = 'complete'").agg(F.max_by(F.struct(*scans.columns), F.struct("completed_at", "scan_id")).alias("s")).filter("s IS NOT NULL").select("s.*")


def first_seen(state: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The state and those rows of new keys; known keys keep their first row."""
    new = incoming.dropDuplicates([key]).join(state.select(key), key, "left_anti")
    return state.unionByName(new.select(*state.columns))


def insert_or_ignore(state: DataFrame, incoming: DataFrame) -> DataFrame:
    return state.unionByName(incoming.select(*state.columns)).dropDuplicates()


def insert_only(state: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The state with the new rows, and the keys that were there or come twice: a violation each."""
    n = incoming.groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = n.join(state.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left").filter("_n > 1 OR _old").select(*keys)
    return state.unionByName(incoming.join(bad, keys, "left_anti").select(*state.columns)), bad


def regenerate(state: DataFrame, rows: DataFrame, source: str = "rule") -> DataFrame:
    """The state (.., source) with the rows of one source replaced."""
    return state.filter(F.col("source") != source).unionByName(rows.withColumn("source", F.lit(source)).select(*state.columns))


def upsert_picks(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """Picks (sample_id, kit, query, picked_at): of each sample and kit the latest."""
    return upsert(state, incoming, ["sample_id", "kit"], [F.desc("picked_at"), "query"])


def lookup(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of one path or id; reading the result fails if there is none."""
    hits = df.filter(F.col(column) == value)
    none = df.agg(F.count_if(F.col(column) == value).alias("_n")).filter(F.col("_n") == 0)
    return gates.strict(hits, none.select(F.lit(f"no {column} {value!r}").alias("violation")))


def identified(manifest: DataFrame, locations: DataFrame, scan_id: str) -> DataFrame:
    """A manifest (path, ..) after its scan_id and sample_id, blank for unknown paths."""
    known = locations.filter("exists_now").groupBy("path").agg(F.max("sample_id").alias("_id"))
    j = manifest.join(known, "path", "left")
    return j.select(F.lit(scan_id).alias("scan_id"), F.coalesce("_id", F.lit("")).alias("sample_id"), *manifest.columns)


def under(locations: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Locations at or below each prefix (prefix): ancestors meet on equality."""
    own = locations.withColumn("prefix", F.col("path"))
    return ancestors(locations.filter(F.contains("path", F.lit("/"))), "path", "prefix").unionByName(own).join(prefixes.select("prefix").distinct(), "prefix")
