"""Queries over the reference data, by name, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratelake import bed
from cratelake.bed import FEAT, LOC
from cratelake.functions import paths
from cratelake.operators import catalog, evaluate, ladders, select, similar

F6 = lambda c: F.round(c, 6)
TEXT = "replace(replace(replace(lower(path), '_', ' '), '.', ' '), '/', ' / ')"
QUOTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _first(text: str, words: tuple) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words) + " END"


def catalogue_zones(spark, d):
    loc = bed.locations(spark, d)
    return loc.groupBy(paths.zone(F.col("path")).alias("zone"), ladders.role(F.col("path"))["role"].alias("role")).agg(F.count("*").alias("n"))


def role_classify(spark, d):
    p = F.col("path")
    return bed.locations(spark, d).select("doc_id", ladders.role(p).alias("r")).select("doc_id", "r.role", "r.confidence", "r.reason")


_STEM_HIT = "CASE " + " ".join(f"WHEN starts_with(t, '{s}') THEN '{s}'" for _, ss in ladders.STEMS for s in ss) + " END"
ROLE_CTE = (
    f"""toks AS (SELECT doc_id, path, {TEXT} AS text, list_sort(list_distinct(list_filter(regexp_split_to_array({TEXT}, '[^a-z0-9#b]+'), lambda t: t <> ''))) AS toks FROM loc),
steps AS (SELECT doc_id, path, list_filter([
  {{'role': 'DRUM-LOOPS', 'confidence': 'high', 'reason': 'path:' || {_first("text", ladders.LOOP_PHRASES)}}},"""
    + ", ".join(f"{{'role': '{r}', 'confidence': 'high', 'reason': 'path:' || {_first('text', ws)}}}" for r, ws in ladders.ROLE_WORDS)
    + ", "
    + ", ".join(f"{{'role': '{r}', 'confidence': 'high', 'reason': 'token:' || list_min(list_intersect(toks, {QUOTED(cs)}))}}" for r, cs in ladders.CODES)
    + f""", {{'role': 'PERC', 'confidence': 'high', 'reason': 'token:' || list_filter(list_transform(toks, lambda t: {_STEM_HIT}), lambda x: x IS NOT NULL)[1]}},
  {{'role': 'DRUM-LOOPS', 'confidence': 'medium', 'reason': CASE WHEN contains(text, 'loop') OR contains(text, 'groove') OR regexp_matches(path, '(?i)(^|[^0-9])[0-9]{{2,3}}\\s*bpm([^0-9]|$)') THEN 'path:loop' END}},
  {{'role': '_REVIEW', 'confidence': 'low', 'reason': 'unmatched'}}], lambda s: s.reason IS NOT NULL)[1] AS r FROM toks),
roles AS (SELECT doc_id, path, r.role AS role, r.confidence AS confidence, r.reason AS reason FROM steps)"""
)
ZONE = "CASE WHEN contains(path, '/') AND split_part(path, '/', 1) IN ('PACKS', 'CATALOGUE', 'CURATED') THEN split_part(path, '/', 1) ELSE 'ROOT' END"


def instrument_suggest(spark, d):
    return bed.locations(spark, d).select("doc_id", ladders.instrument(F.col("path")).alias("suggested"))


_PAD = "' ' || replace(replace(replace(lower(path), '/', ' '), '_', ' '), '-', ' ') || ' '"
INSTRUMENT_SQL = f"WITH {LOC} SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN {_first(_PAD, ws)} IS NOT NULL THEN '{r}' END" for r, ws in ladders.INSTRUMENTS) + ", '') AS suggested FROM loc"


def bpm_tempo(spark, d):
    loc = bed.locations(spark, d).withColumn("bpm", paths.bpm(F.col("path")))
    return loc.select("doc_id", "bpm", paths.tempo_fit(F.col("bpm")).alias("tempo_fit"), paths.normalise_token(paths.stem(F.col("path"))).alias("token"))


BPM_SQL = rf"""WITH {LOC}, b AS (SELECT doc_id, path, coalesce(
    nullif(regexp_extract(path, '(?i)(?:^|[^0-9])([0-9]{{2,3}})\s*bpm(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(path, '\[([0-9]{{2,3}})\]', 1), ''),
    CASE WHEN contains({TEXT}, 'loop') OR contains({TEXT}, 'groove') THEN nullif(regexp_extract(path, '(?i)(?:^|[^a-z0-9])([6-9][0-9]|1[0-9][0-9]|200)(?:[^a-z0-9]|$)', 1), '') END) AS bpm,
    regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '') AS stem FROM loc)
SELECT doc_id, bpm, CASE WHEN bpm IS NULL THEN 'unknown' WHEN bpm::INT BETWEEN 130 AND 150 THEN 'techno-core' WHEN bpm::INT BETWEEN 124 AND 129 THEN 'techno-adjacent' WHEN bpm::INT < 124 THEN 'house-lower' ELSE 'too-fast' END AS tempo_fit,
  coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(trim(stem)), '''', ''), '&', 'and'), '[^a-z0-9._-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '_{{2,}}', '_', 'g'), '-_'), ''), 'sample') AS token
FROM b"""


def content_identity(spark, d):
    loc = bed.locations(spark, d)
    return loc.groupBy("sample_id").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.min("size").alias("size"))


def exact_dedup_plan(spark, d):
    """Cheap key first: only files that share size and name are compared by hash; the shallowest,
    then shortest, then first path is kept."""
    loc = bed.locations(spark, d).withColumn("name", F.lower("word"))
    often = loc.groupBy("size", "name").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    some = loc.join(often, ["size", "name"], "left_semi")
    keep = some.groupBy("sample_id").agg(F.min(F.struct(F.size(paths.parts(F.col("path"))), F.length("path"), "path")).alias("_k"))
    return some.join(keep, "sample_id").filter(F.col("path") != F.col("_k.path")).select("sample_id", F.col("_k.path").alias("keep"), F.col("path").alias("remove"), "size")


def spread_roundrobin(spark, d):
    loc = bed.locations(spark, d).select("path", F.get(paths.parts(F.col("path")), F.lit(1)).alias("source"), paths.zone(F.col("path")).alias("zone"))
    return select.round_robin(loc, ["path"], ["source"], ["source"], ["zone"], 40).select("zone", "place", "turn", "source", "path")


def stratified_pick(spark, d):
    f = bed.features(spark, d).select("sample_id", "role", F.lpad(F.col("sample_id").cast("string"), 8, "0").alias("path"), F.col("v")[3].alias("value"))
    return select.stratified(f, "value", F.substring("path", 8, 1), ["role"]).select("sample_id", "role", "bucket")


def preferred_picks(spark, d):
    """Users by their kept days, the most first, then by id: the first thousand, with their places."""
    e = spark.read.parquet(f"{d}/events.parquet")
    picks = e.groupBy("user_id", F.to_date("ts").alias("kit")).agg(F.max_by(F.col("event_type") != "error", F.struct("ts", "event_id")).alias("kept"))
    n = picks.filter("kept").groupBy("user_id").agg(F.count("*").alias("picks")).orderBy(F.desc("picks"), "user_id").limit(1000)
    return select.global_place(n, [F.desc("picks"), F.col("user_id")], "place")


def similar_to(spark, d):
    f = similar.nearest(bed.features(spark, d), 7, "v", 16, 50)
    return f.select("sample_id", "role", F6("distance").alias("distance"))


def _scans(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("path"), "value")
    last = e.agg(F.max("day").alias("_last"))
    e = e.join(F.broadcast(last))
    before = e.filter("day < _last").groupBy("path").agg(F.max_by("value", F.struct("day", "value")).alias("version"))
    return before, e.filter("day = _last").groupBy("path").agg(F.max("value").alias("version"))


def snapshot_merge(spark, d):
    return catalog.snapshot_merge(*_scans(spark, d))


def scan_drift(spark, d):
    return catalog.drift(*_scans(spark, d), "path")


_SCANS = """e AS (SELECT ts::DATE AS day, user_id::VARCHAR AS path, value FROM events), z AS (SELECT max(day) AS l FROM e),
state AS (SELECT path, arg_max(value, (day, value)) AS version FROM e, z WHERE day < l GROUP BY path), scan AS (SELECT path, max(value) AS version FROM e, z WHERE day = l GROUP BY path)"""


def set_registry(spark, d):
    loc = bed.locations(spark, d)
    under = catalog.ancestors(loc, "path", "folder")
    return under.groupBy("folder").agg(F.count("*").alias("files"), F.count_if(F.col("path").endswith(".wav")).alias("wavs"), F.min("path").alias("first_path"))


def cascading_lookup(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("w"), (F.col("doc_id") % 24).cast("string"))
    items = docs.select("doc_id", F.col("n_chars").alias("size"), (F.col("doc_id") % 50).alias("mtime_ms"), name.alias("name"))
    legacy = items.filter("doc_id % 3 <> 0").select("size", "mtime_ms", "name", (F.col("doc_id") % 100).alias("payload"))
    moved = items.withColumn("name", F.when(F.col("doc_id") % 4 == 1, "other").otherwise(F.col("name")))
    return catalog.cascading(moved, legacy)


def path_keys(spark, d):
    p = F.col("path")
    return bed.locations(spark, d).select("doc_id", paths.short_id(p).alias("short_id"), paths.source_group(p).alias("source_group"), paths.content_path(p).alias("content_path"))


def token_vocabulary(spark, d):
    """Source tokens of generated one-shot names, of those that stand three times or more."""
    loc = bed.locations(spark, d).select(paths.source_token(F.col("path")).alias("token")).filter("token IS NOT NULL")
    return loc.groupBy("token").agg(F.count("*").alias("n")).filter("n >= 3")


def latest_scan(spark, d):
    """Each day of events is a scan, complete unless its last event is an error."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("day", F.to_date("ts"))
    scans = e.groupBy("day").agg(F.max("ts").alias("completed_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("file_count"))
    return scans.filter("last <> 'error'").agg(F.max_by(F.col("day").cast("string"), "completed_at").alias("scan_id"), F.max_by("file_count", "completed_at").alias("file_count"))


DOMAIN = ("good", "junk", "toxic")


def _truth(spark, d):
    lab, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    truth = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("junk")
    guess = F.when(F.col("n_chars") % 5 == 0, None).when(F.col("n_chars") < 300, "junk").when(F.col("n_chars") % 11 == 0, "toxic").otherwise("good")
    return lab.join(docs, "doc_id", "left").select(truth.alias("truth"), F.coalesce(guess, F.lit("OTHER")).alias("predicted"))


TRUTH = """t AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'junk' END AS truth,
  coalesce(CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars < 300 THEN 'junk' WHEN n_chars % 11 = 0 THEN 'toxic' ELSE 'good' END, 'OTHER') AS predicted FROM labels LEFT JOIN documents USING (doc_id))"""


def confusion(spark, d):
    return evaluate.confusion(_truth(spark, d))


def precision_recall(spark, d):
    s = evaluate.scores(_truth(spark, d), DOMAIN)
    return s.select("role", "support", F6("precision").alias("precision"), F6("recall").alias("recall"), F6("f1").alias("f1"))


def route_counts(spark, d):
    """Current to suggested role where they differ."""
    loc = bed.locations(spark, d).select(ladders.role(F.col("path"))["role"].alias("current"), ladders.instrument(F.col("path")).alias("suggested"))
    return loc.filter("current <> suggested").groupBy("current", "suggested").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    catalogue_zones, role_classify, instrument_suggest, bpm_tempo, content_identity, exact_dedup_plan, spread_roundrobin, stratified_pick, preferred_picks, similar_to,
    snapshot_merge, scan_drift, set_registry, cascading_lookup, confusion, precision_recall, route_counts, path_keys, token_vocabulary, latest_scan,
)}

_SIM = "list_transform(range(1, 17), lambda i: CASE WHEN f.v[i] IS NULL OR t.v[i] IS NULL THEN NULL ELSE pow((f.v[i] - low[i]) / span[i] - (t.v[i] - low[i]) / span[i], 2) END)"
ORACLE_SQL = {
    "catalogue_zones": f"WITH {LOC}, {ROLE_CTE} SELECT {ZONE} AS zone, role, count(*) AS n FROM roles GROUP BY ALL",
    "role_classify": f"WITH {LOC}, {ROLE_CTE} SELECT doc_id, role, confidence, reason FROM roles",
    "instrument_suggest": INSTRUMENT_SQL,
    "bpm_tempo": BPM_SQL,
    "content_identity": f"WITH {LOC} SELECT sample_id, min(path) AS path, count(*) AS copies, min(size) AS size FROM loc GROUP BY sample_id",
    "exact_dedup_plan": f"""WITH {LOC}, s AS (SELECT *, count(*) OVER (PARTITION BY size, lower(word)) AS n FROM loc), r AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS m,
  row_number() OVER w AS rank, first_value(path) OVER w AS keep FROM s WHERE n > 1 WINDOW w AS (PARTITION BY sample_id ORDER BY len(string_split(path, '/')), length(path), path))
SELECT sample_id, keep, path AS remove, size FROM r WHERE m > 1 AND rank > 1""",
    "spread_roundrobin": f"""WITH {LOC}, s AS (SELECT path, split_part(path, '/', 2) AS source, {ZONE} AS zone FROM loc), t AS (SELECT *, row_number() OVER (PARTITION BY zone, source ORDER BY path) AS turn FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY turn, source) AS place FROM t) SELECT zone, place, turn, source, path FROM p WHERE place <= 40""",
    "stratified_pick": f"""WITH {FEAT}, f AS (SELECT sample_id, role, lpad(sample_id::VARCHAR, 8, '0') AS path, v[4] AS value FROM feat),
a AS (SELECT *, count(*) OVER (PARTITION BY role) AS n, count(value) OVER (PARTITION BY role) AS m, row_number() OVER (PARTITION BY role, value IS NULL ORDER BY value, path) - 1 AS rn FROM f),
b AS (SELECT *, CASE WHEN value IS NULL THEN 5 ELSE least(4, floor(rn / ceil(m / 5.0::DOUBLE)))::INT END AS bucket FROM a),
c AS (SELECT role, bucket, count(*) AS size, min(n) AS n FROM b GROUP BY ALL), q AS (SELECT *, 25.0::DOUBLE * size / n AS raw FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY raw - floor(raw) DESC, bucket) AS nxt, 25 - sum(floor(raw)) OVER (PARTITION BY role) AS short FROM q),
k AS (SELECT role, bucket, CASE WHEN n <= 25 THEN size ELSE floor(raw) + (nxt <= short)::INT END AS quota FROM r),
g AS (SELECT b.*, row_number() OVER (PARTITION BY role, bucket, path[8:8] ORDER BY path) AS turn FROM b),
h AS (SELECT *, row_number() OVER (PARTITION BY role, bucket ORDER BY turn, path) AS place FROM g)
SELECT sample_id, role, bucket FROM h JOIN k USING (role, bucket) WHERE place <= quota""",
    "preferred_picks": "WITH p AS (SELECT user_id, ts::DATE AS kit, arg_max(event_type <> 'error', (ts, event_id)) AS kept FROM events GROUP BY ALL) SELECT user_id, count(*) AS picks, row_number() OVER (ORDER BY count(*) DESC, user_id) AS place FROM p WHERE kept GROUP BY user_id ORDER BY place LIMIT 1000",
    "similar_to": f"""WITH {FEAT}, u AS (SELECT unnest(range(1, 17)) AS i), m AS (SELECT i, min(v[i]) AS lo, max(v[i]) AS hi FROM feat, u GROUP BY i),
x AS (SELECT list(lo ORDER BY i) AS low, list(CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END ORDER BY i) AS span FROM m),
s AS (SELECT f.sample_id, f.role, list_filter({_SIM}, lambda g: g IS NOT NULL) AS gaps FROM feat f, (SELECT v FROM feat WHERE sample_id = 7) t, x)
SELECT sample_id, role, round(sqrt(list_sum(gaps) / len(gaps)), 6) AS distance FROM s WHERE len(gaps) > 0 ORDER BY sqrt(list_sum(gaps) / len(gaps)), sample_id LIMIT 50""",
    "snapshot_merge": f"WITH {_SCANS} SELECT path, CASE WHEN s.path IS NOT NULL THEN s.version ELSE t.version END AS version, s.path IS NOT NULL AS exists_now FROM state t FULL JOIN scan s USING (path)",
    "scan_drift": f"WITH {_SCANS} SELECT path, 'previous-only' AS side FROM state WHERE path NOT IN (SELECT path FROM scan) UNION ALL SELECT path, 'current-only' FROM scan WHERE path NOT IN (SELECT path FROM state)",
    "set_registry": f"""WITH {LOC}, a AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM loc)
SELECT folder, count(*) AS files, count(*) FILTER (WHERE path LIKE '%.wav') AS wavs, min(path) AS first_path FROM a GROUP BY folder""",
    "cascading_lookup": """WITH i AS (SELECT doc_id, n_chars AS size, doc_id % 50 AS mtime_ms, 'w' || (doc_id % 24) AS name FROM documents), l AS (SELECT size, mtime_ms, name, doc_id % 100 AS payload FROM i WHERE doc_id % 3 <> 0),
x AS (SELECT size, mtime_ms, name, min(payload) AS e FROM l GROUP BY ALL), p AS (SELECT size, mtime_ms, min(payload) AS q FROM l GROUP BY ALL HAVING min(payload) = max(payload)),
n AS (SELECT doc_id, size, mtime_ms, CASE WHEN doc_id % 4 = 1 THEN 'other' ELSE name END AS name FROM i)
SELECT doc_id, size, mtime_ms, name, coalesce(e, q) AS payload, CASE WHEN e IS NOT NULL THEN 'exact' WHEN q IS NOT NULL THEN 'pair' ELSE 'measure' END AS status FROM n LEFT JOIN x USING (size, mtime_ms, name) LEFT JOIN p USING (size, mtime_ms)""",
    "path_keys": f"""WITH {LOC}, p AS (SELECT *, string_split(path, '/') AS parts FROM loc) SELECT doc_id, sha256(path)[1:12] AS short_id, CASE WHEN len(parts) > 3 THEN parts[3] ELSE '_root' END AS source_group,
  CASE WHEN {ZONE} = 'CURATED' AND len(parts) > 2 THEN array_to_string(parts[3:], '/') ELSE path END AS content_path FROM p""",
    "token_vocabulary": f"""WITH {LOC}, s AS (SELECT regexp_replace(regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), '-[0-9]+$', '') AS s FROM loc),
t AS (SELECT nullif(regexp_extract(s, '^[^_]*_(.*)$', 1), '') AS token FROM s WHERE s = lower(s) AND NOT regexp_matches(split_part(s, '_', 1), '^([0-9]{{2,3}}|[a-g][sb]?m?)$'))
SELECT token, count(*) AS n FROM t WHERE token IS NOT NULL GROUP BY token HAVING count(*) >= 3""",
    "latest_scan": """WITH s AS (SELECT ts::DATE AS day, max(ts) AS completed_at, arg_max(event_type, (ts, event_id)) AS last, count(*) AS file_count FROM events GROUP BY ALL)
SELECT arg_max(day::VARCHAR, completed_at) AS scan_id, arg_max(file_count, completed_at) AS file_count FROM s WHERE last <> 'error'""",
    "confusion": f"WITH {TRUTH} SELECT truth, predicted, count(*) AS n FROM t GROUP BY ALL",
    "precision_recall": f"""WITH {TRUTH}, r AS (SELECT unnest({QUOTED(DOMAIN)}) AS role), s AS (SELECT role, (SELECT count(*) FROM t WHERE truth = role) AS support, (SELECT count(*) FROM t WHERE truth = role AND predicted = role) AS tp, (SELECT count(*) FROM t WHERE predicted = role) AS named FROM r),
p AS (SELECT role, support, CASE WHEN named > 0 THEN tp / named::DOUBLE ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END AS r FROM s)
SELECT role, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p""",
    "route_counts": INSTRUMENT_SQL.replace("WITH ", f"WITH {LOC}, {ROLE_CTE}, i AS (WITH ", 1) + ") SELECT role AS current, suggested, count(*) AS n FROM roles JOIN i USING (doc_id) WHERE role <> suggested GROUP BY ALL",
}
