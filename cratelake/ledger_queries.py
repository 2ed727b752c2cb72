"""Queries of records, caches, crates for devices, references and moves, and their SQL, which is written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratelake import bed
from cratelake.bed import LIB, LOC
from cratelake.operators import audit, benchmark, catalog, gates, plans, signals
from cratelake.review_queries import _norm


def _i():
    return F.col("doc_id")


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _case(by, *values):
    """The value of each remainder."""
    return F.get(F.array(*[v if hasattr(v, "alias") else F.lit(v).cast("string") for v in values]), (by % len(values)).cast("int"))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- records


def asset_ledger(spark, d):
    """The scan in which each content was first seen: a third of the documents in one, all in the next."""
    rows = bed.locations(spark, d).filter("sample_id IS NOT NULL")
    seen = lambda df, name: df.select("sample_id", F.lit(name).alias("first_scan"))
    one = catalog.first_seen(seen(rows, "one").limit(0), seen(rows.filter(_i() % 3 == 0), "one"), "sample_id")
    return catalog.first_seen(one, seen(rows, "two"), "sample_id")


ASSET_SQL = f"WITH {LOC} SELECT sample_id, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'one' ELSE 'two' END AS first_scan FROM loc WHERE sample_id IS NOT NULL GROUP BY sample_id"


def pick_ledger(spark, d):
    """The latest pick of each sample and kit after two runs."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("kit"), F.col("o_orderstatus").alias("query"), F.col("o_orderdate").cast("date").cast("string").alias("picked_at"))
    half = lambda k: rows.filter(F.col("o_orderkey") % 2 == k).drop("o_orderkey")
    return catalog.upsert_picks(catalog.upsert_picks(half(0).limit(0), half(0)), half(1))


PICK_SQL = """WITH p AS (SELECT o_orderkey % 2 AS run, o_custkey::VARCHAR AS sample_id, o_orderpriority AS kit, o_orderstatus AS query, o_orderdate::DATE::VARCHAR AS picked_at FROM orders)
SELECT sample_id, kit, query, picked_at FROM p QUALIFY row_number() OVER (PARTITION BY sample_id, kit ORDER BY run DESC, picked_at DESC, query) = 1"""


def tag_ledger(spark, d):
    """Tags after the rules' were made anew, those by hand kept."""
    docs = bed.locations(spark, d)
    row = lambda df, group, tag, source: df.select("doc_id", F.lit(group).alias("tag_group"), tag.alias("tag"), F.lit(source).alias("source"))
    state = row(docs, "form", F.col("word"), "rule").unionByName(row(docs.filter(_i() % 4 == 0), "mood", F.lit("dark"), "hand"))
    return catalog.regenerate(state, row(docs.filter(_i() % 2 == 0), "form", F.upper("word"), "rule"))


TAG_SQL = f"""WITH {LOC} SELECT doc_id, 'form' AS tag_group, upper(word) AS tag, 'rule' AS source FROM loc WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'mood', 'dark', 'hand' FROM loc WHERE doc_id % 4 = 0"""


def promotion_ledger(spark, d):
    """Promotions after an insert of which some are there and some come twice, and these as violations."""
    docs = _docs(spark, d).select(_i().cast("string").alias("sample_id"), _text("CURATED/", _i()).alias("curated_path"), "doc_id")
    incoming = docs.filter(_i() % 3 == 0).unionByName(docs.filter(_i() % 9 == 0)).drop("doc_id")
    kept, bad = catalog.insert_only(docs.filter(_i() % 5 == 0).drop("doc_id"), incoming, ["sample_id", "curated_path"])
    return kept.withColumn("kind", F.lit("kept")).unionByName(bad.withColumn("kind", F.lit("violation")))


PROMOTION_SQL = """SELECT doc_id::VARCHAR AS sample_id, 'CURATED/' || doc_id AS curated_path, 'kept' AS kind FROM documents WHERE doc_id % 5 = 0 OR (doc_id % 3 = 0 AND doc_id % 9 <> 0)
UNION ALL SELECT doc_id::VARCHAR, 'CURATED/' || doc_id, 'violation' FROM documents WHERE doc_id % 3 = 0 AND (doc_id % 5 = 0 OR doc_id % 9 = 0)"""


def ignored_inserts(spark, d):
    """Origins after an insert that ignores what is there."""
    rows = _docs(spark, d).select("doc_id", "source", "lang")
    return catalog.insert_or_ignore(rows.filter(_i() % 2 == 0).drop("doc_id"), rows.drop("doc_id"))


IGNORED_SQL = "SELECT DISTINCT source, lang FROM documents"


def feature_cache(spark, d):
    """Cached features that still hold: size and time agree, and no error was noted."""
    rows = bed.locations(spark, d).withColumn("mtime", _i() % 7)
    cache = rows.select("path", F.when(_i() % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", F.when(_i() % 6 == 0, "bad").when(_i() % 6 == 1, "").alias("error"), (_i() * 2).alias("v"))
    return signals.cached(rows.select("path", "size", "mtime"), cache)


CACHE_SQL = f"WITH {LOC} SELECT path, size, doc_id % 7 AS mtime, doc_id * 2 AS v FROM loc WHERE doc_id % 4 <> 0 AND doc_id % 6 <> 0 AND size IS NOT NULL AND path IS NOT NULL"


# ---- crates


def _crate(spark, d):
    """A crate of all documents, its files as they are, and the device that it is for."""
    docs = bed.locations(spark, d)
    path = _text(F.when(_i() % 11 == 0, "PACKS/").otherwise("CURATED/"), "f", _i(), ".wav")
    own, role = F.sha2(_i().cast("string"), 256), _case(_i(), "KICK", "SNARE", "HAT-OPEN", "BASS", "DRUM-LOOP", "NOPE")
    crate = docs.select(_i().alias("row"), own.alias("sample_id"), path.alias("source_path"), role.alias("role"), F.col("word").alias("descriptor"), F.when(_i() % 4 == 0, "stereo-essential").otherwise("").alias("reason"))
    there = docs.filter(_i() % 17 != 0).select(path.alias("path"), F.when(_i() % 13 == 0, "other").otherwise(own).alias("sample_id"), (_i() % 8).cast("double").alias("duration"))
    return plans.crate_plan(crate, "My Crate", there, plans.devices(spark), "tr8s"), crate, there


def crate_export(spark, d):
    return _crate(spark, d)[0][0]


_CRATE = f"""{LOC}, c AS (SELECT doc_id AS row, sha256(doc_id::VARCHAR) AS sample_id, CASE WHEN doc_id % 11 = 0 THEN 'PACKS/' ELSE 'CURATED/' END || 'f' || doc_id || '.wav' AS source_path,
  ['KICK', 'SNARE', 'HAT-OPEN', 'BASS', 'DRUM-LOOP', 'NOPE'][doc_id % 6 + 1] AS role, ['BD', 'SD', 'OH', 'BS', 'DL', NULL][doc_id % 6 + 1] AS code, word FROM loc),
n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY row) AS i FROM c), o AS (SELECT *, code || CASE WHEN i < 10 THEN '0' ELSE '' END || i || '_' || {_norm("word")}[1:8] || '_' || sample_id[1:4] || '.wav' AS out_name FROM n)"""
CRATE_SQL = f"WITH {_CRATE} SELECT row, source_path, out_name, concat_ws('/', 'ROLAND/TR-8S/SAMPLE/my-crate', out_name) AS out_path, row % 4 = 0 AS keep_stereo FROM o"


def crate_faults(spark, d):
    return _crate(spark, d)[0][1]


FAULTS_SQL = f"""WITH {_CRATE}, t AS (SELECT count(*) AS n, sum(CASE WHEN row % 17 <> 0 THEN row % 8 END) AS seconds FROM c)
SELECT row, 'unknown role' AS violation FROM c WHERE role = 'NOPE' UNION ALL SELECT row, 'one-shot roles only' FROM c WHERE role = 'DRUM-LOOP' UNION ALL SELECT row, 'missing source' FROM c WHERE row % 17 = 0
UNION ALL SELECT row, 'source outside CURATED' FROM c WHERE row % 17 <> 0 AND row % 11 = 0 UNION ALL SELECT row, 'hash changed' FROM c WHERE row % 17 <> 0 AND row % 13 = 0
UNION ALL SELECT NULL, 'too many rows' FROM t WHERE n > 256 UNION ALL SELECT NULL, 'too long' FROM t WHERE seconds > 600"""


def crate_gate(spark, d):
    """The rows of the crate's plan that have no fault of their own."""
    (plan, faults), *_ = _crate(spark, d)
    return gates.gate(plan, faults, "row")[0].select("row", "out_name")


GATE_SQL = f"WITH {_CRATE} SELECT row, out_name FROM o WHERE role NOT IN ('NOPE', 'DRUM-LOOP') AND row % 17 <> 0 AND row % 11 <> 0 AND row % 13 <> 0"


def crate_sums(spark, d):
    _, crate, there = _crate(spark, d)
    return plans.crate_totals(crate, there.select(F.col("path").alias("source_path"), "duration"))


SUMS_SQL = "SELECT count(*) AS rows, coalesce(sum(CASE WHEN doc_id % 17 <> 0 THEN doc_id % 8 END), 0)::DOUBLE AS seconds FROM documents"


# ---- references and moves


def reclaimable_bytes(spark, d):
    rows = bed.locations(spark, d)
    return plans.reclaimable(rows.filter(_i() % 3 == 0).select(F.col("path").alias("src")), rows)


BYTES_SQL = f"WITH {LOC} SELECT coalesce(sum(size), 0)::BIGINT AS bytes, count(*) AS files FROM loc WHERE path IN (SELECT path FROM loc WHERE doc_id % 3 = 0)"


def set_references(spark, d):
    """References of projects to samples: absolute, relative with and without steps up, lost, and without any path."""
    docs, home = _docs(spark, d), _text("/p/set", _i() % 5)
    raw = _case(_i(), _text("/lib/k", _i(), ".wav"), _text("/gone/k", _i(), ".wav"), "")
    rel = _case(_i(), None, _text("../k", _i(), ".wav"), _text("sub/./y", _i(), ".wav"), _text("x", _i(), ".wav"))
    refs = docs.select(_text(home, "/a.als").alias("set_path"), raw.alias("raw_path"), rel.alias("relative_path"))
    there = [docs.filter(_i() % 2 == 0).select(_text("/lib/k", _i(), ".wav").alias("path")), docs.filter(_i() % 5 < 3).select(_text("/p/k", _i(), ".wav").alias("path")), docs.filter(_i() % 7 < 4).select(_text(home, "/sub/y", _i(), ".wav").alias("path"))]
    return plans.references(refs, there[0].unionByName(there[1]).unionByName(there[2]))


REFERENCES_SQL = """WITH r AS (SELECT doc_id AS i, '/p/set' || doc_id % 5 AS home, ['/lib/k' || doc_id || '.wav', '/gone/k' || doc_id || '.wav', ''][doc_id % 3 + 1] AS raw_path,
  [NULL, '../k' || doc_id || '.wav', 'sub/./y' || doc_id || '.wav', 'x' || doc_id || '.wav'][doc_id % 4 + 1] AS relative_path FROM documents),
f AS (SELECT *, CASE i % 4 WHEN 1 THEN '/p/k' || i || '.wav' WHEN 2 THEN home || '/sub/y' || i || '.wav' WHEN 3 THEN home || '/x' || i || '.wav' END AS rel, i % 3 = 0 AND i % 2 = 0 AS a, (i % 4 = 1 AND i % 5 < 3) OR (i % 4 = 2 AND i % 7 < 4) AS b FROM r)
SELECT home || '/a.als' AS set_path, raw_path, relative_path, CASE WHEN a THEN raw_path WHEN b THEN rel ELSE coalesce(nullif(raw_path, ''), rel) END AS resolved, a OR b AS present FROM f"""


def zone_migration(spark, d):
    """The moves of two zones, and what stands in their way: projects, files that are there, files that changed."""
    files, n = bed.library(spark, d), F.length("path")
    sha = lambda *x: F.sha2(F.concat("path", *map(F.lit, x)), 256).alias("sample_id")
    moves = spark.createDataFrame([("PACKS", "CATALOGUE/PACKS", "packs"), ("CURATED/KICKS", "CATALOGUE/KICKS", "legacy")], "prefix string, to string, tag string")
    now = files.filter(n % 7 != 0).select("path", F.when(n % 5 == 0, sha("x")).otherwise(sha()).alias("sample_id"))
    there = files.filter(F.col("path").startswith("CURATED/KICKS/") & (n % 3 == 0)).select(F.concat(F.lit("CATALOGUE"), F.substr("path", F.lit(8))).alias("path"), F.lit("5").alias("sample_id"))
    projects = _docs(spark, d).select(_text("s", _i(), F.when(_i() % 100 == 0, "/Backup").otherwise(""), "/one.als").alias("path"), F.when(_i() % 50 == 0, "to CURATED/x").otherwise("none").alias("content"))
    plan, faults = plans.migration(files.select("path", sha()), moves, plans.zone_references(projects), now.unionByName(there))
    moved = plan.select(F.lit("move").alias("kind"), F.col("src").alias("path"), F.concat_ws("|", "dest", "tag").alias("text"))
    return moved.unionByName(faults.select(F.lit("fault").alias("kind"), "path", F.col("violation").alias("text")))


MIGRATION_SQL = f"""WITH {LIB}, p AS (SELECT path AS src, length(path) AS n, 'CATALOGUE/PACKS' || path[6:] AS dest, 'packs' AS tag FROM lib WHERE starts_with(path, 'PACKS/')
  UNION ALL SELECT path, length(path), 'CATALOGUE/KICKS' || path[14:], 'legacy' FROM lib WHERE starts_with(path, 'CURATED/KICKS/'))
SELECT 'move' AS kind, src AS path, dest || '|' || tag AS text FROM p UNION ALL SELECT 'fault', src, 'hash changed since the scan' FROM p WHERE n % 7 = 0 OR n % 5 = 0
UNION ALL SELECT 'fault', dest, 'destination exists' FROM p WHERE tag = 'legacy' AND n % 3 = 0 UNION ALL SELECT 'fault', 's' || doc_id || '/one.als', 'a project names the zone' FROM documents WHERE doc_id % 50 = 0 AND doc_id % 100 <> 0"""


# ---- faults of sheets


def truth_faults(spark, d):
    role = _case(_i(), "", None, " kick ", "kick", "nope")
    return benchmark.label_violations(_docs(spark, d).select(_i().cast("string").alias("path"), role.alias("true_role")), ("kick", "snare"))


TRUTH_SQL = "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 < 2 THEN 'unlabelled row' ELSE 'invalid true_role' END AS violation FROM documents WHERE doc_id % 5 IN (0, 1, 4)"


def audit_faults(spark, d):
    path = _case(_i(), _text("CURATED/KICKS/", _i()), _text("CURATED/PERC/", _i()), _text("PACKS/", _i()), _text("CURATED/KICKS/../", _i()))
    rows = _docs(spark, d).select(path.alias("path"), _case(_i(), "KICKS", "PERC", "BASS").alias("current_role"), _case(_i(), "REVIEW", "KICKS", "BASS", "ZZZ", None).alias("suggested_role"))
    return audit.violations(rows)


AUDIT_FAULTS_SQL = """WITH a AS (SELECT ['CURATED/KICKS/' || doc_id, 'CURATED/PERC/' || doc_id, 'PACKS/' || doc_id, 'CURATED/KICKS/../' || doc_id][doc_id % 4 + 1] AS path, doc_id % 4 AS p, doc_id % 3 AS c, doc_id % 5 AS s FROM documents)
SELECT path, 'outside its role''s folder' AS violation FROM a WHERE NOT (p = 0 AND c = 0 OR p = 1 AND c = 1) UNION ALL SELECT path, 'unsupported source role' FROM a WHERE c = 2 UNION ALL SELECT path, 'unsupported suggested role' FROM a WHERE s IN (3, 4)"""


def scan_sheet(spark, d):
    """The row of the latest complete scan of three, of which the last broke off."""
    files = bed.library(spark, d)
    row = lambda k, done: catalog.scan_row(files.filter(F.length("path") % 4 >= k), f"scan{k}", "/lib", f"t{k}", done)
    return catalog.latest_complete(row(0, "t0.5").unionByName(row(1, "t1.5")).unionByName(row(2, None)))


SHEET_SQL = f"WITH {LIB} SELECT 'scan1' AS scan_id, '/lib' AS root, 't1' AS started_at, 'complete' AS status, 't1.5' AS completed_at, count(*) AS file_count FROM lib WHERE length(path) % 4 >= 1"


QUERIES = {f.__name__: f for f in (
    asset_ledger, pick_ledger, tag_ledger, promotion_ledger, ignored_inserts, feature_cache, crate_export, crate_faults, crate_gate, crate_sums, reclaimable_bytes, set_references, zone_migration, truth_faults, audit_faults, scan_sheet,
)}

ORACLE_SQL = {
    "asset_ledger": ASSET_SQL, "pick_ledger": PICK_SQL, "tag_ledger": TAG_SQL, "promotion_ledger": PROMOTION_SQL, "ignored_inserts": IGNORED_SQL, "feature_cache": CACHE_SQL, "crate_export": CRATE_SQL, "crate_faults": FAULTS_SQL,
    "crate_gate": GATE_SQL, "crate_sums": SUMS_SQL, "reclaimable_bytes": BYTES_SQL, "set_references": REFERENCES_SQL, "zone_migration": MIGRATION_SQL, "truth_faults": TRUTH_SQL, "audit_faults": AUDIT_FAULTS_SQL, "scan_sheet": SHEET_SQL,
}
