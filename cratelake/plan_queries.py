"""Queries of plans, registries, audits, search and curation, and their SQL, whose constants are written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratelake import bed
from cratelake.bed import FEAT, LIB, LOC
from cratelake.functions import analysis, names, paths
from cratelake.operators import audit, benchmark, catalog, curation, find, ladders, neardupe, plans, report, select, sets, signals, tags
from cratelake.operators.vocabulary import RULES
from cratelake.queries import ROLE_CTE
from cratelake.review_queries import HITS, _names_sql, _samples
from cratelake.staging import staged

#: What stands in the place of LOC where a query reads the library's files.
FILES = f"{LIB}, loc AS (SELECT row_number() OVER (ORDER BY path) AS doc_id, path FROM lib)"


def _p():
    return F.col("path")


# ---- near duplicates


def near_dup_groups(spark, d):
    """Long loops of one role and name family, scored against the canonical one; a wider cut than the default, as the
    vectors are random."""
    f = bed.features(spark, d)
    v = lambda i: F.abs(F.col("v")[i - 1])
    scale = {"duration_s": 3 + v(1), "tail_ms": 900 + 50 * v(2), "sub_ratio": v(3), "low_ratio": v(5), "mid_ratio": v(6), "high_ratio": v(7), "centroid_hz": 2000 + 90 * v(8), "flatness": v(9), "onset_density": v(10), "zcr": v(11)}
    word = F.element_at(F.array(*map(F.lit, bed.WORDS)), (F.col("sample_id") % 24 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, bed.EXTS)), (F.col("sample_id") % 5 + 1).cast("int"))
    top = F.when(F.col("sample_id") % 6 == 5, "CURATED").otherwise("PACKS")
    rows = f.select("role", F.when(F.col("sample_id") % 11 == 0, "one-shot").otherwise("loop").alias("sample_type"), F.concat_ws("/", top, F.concat(word, F.lit("-"), F.col("sample_id").cast("string"), F.lit("."), ext)).alias("path"), F.concat(word, F.lit(" loop.wav")).alias("proposed_name"), *[c.alias(n) for n, c in scale.items()])
    got = neardupe.groups(rows, 0.6)
    return got.select("group_id", "keep_path", "path", F.round("score", 6).alias("score"), "confidence")


NEAR_SQL = f"""WITH {FEAT}, w AS (SELECT {bed._list(bed.WORDS)} AS words, {bed._list(bed.EXTS)} AS exts),
r AS (SELECT sample_id, role, words[sample_id % 24 + 1] AS word, exts[sample_id % 5 + 1] AS ext,
  CASE WHEN sample_id % 6 = 5 THEN 'CURATED' ELSE 'PACKS' END || '/' || words[sample_id % 24 + 1] || '-' || sample_id || '.' || exts[sample_id % 5 + 1] AS path, list_transform(v, lambda x: abs(x)) AS v FROM feat, w WHERE sample_id % 11 <> 0),
t AS (SELECT *, list_filter(regexp_split_to_array(lower(word || ' loop'), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('wav', 'aif', 'aiff', 'flac', 'mp3', 'ogg', 'one', 'shot', 'oneshot', 'loop', 'loops', 'samples', 'sample')) AS useful FROM r),
f AS (SELECT *, array_to_string(CASE WHEN len(useful) > 0 THEN useful ELSE list_filter(regexp_split_to_array(lower(word || ' loop'), '[^a-z0-9]+'), lambda x: x <> '') END, '-') AS family,
  (path NOT LIKE 'CURATED/%')::INT AS c, CASE ext WHEN 'wav' THEN 0 WHEN 'aif' THEN 1 WHEN 'flac' THEN 2 WHEN 'mp3' THEN 3 ELSE 4 END AS s FROM t WHERE len(list_filter(v[1:3] || v[5:11], lambda x: x IS NULL)) = 0),
k AS (SELECT role, family, arg_min(path, (c, s, len(string_split(path, '/')), length(path), path)) AS keep_path, arg_min(v, (c, s, len(string_split(path, '/')), length(path), path)) AS kv FROM f GROUP BY ALL),
g AS (SELECT role || ':loop:' || family AS group_id, keep_path, path, 1.0::DOUBLE - (0.12 * abs(v[1] - kv[1]) / greatest(3 + v[1], 3 + kv[1], 0.25) + 0.12 * abs(50 * v[2] - 50 * kv[2]) / greatest(900 + 50 * v[2], 900 + 50 * kv[2], 80.0)
  + 0.16 * abs(v[3] - kv[3]) + 0.10 * abs(v[5] - kv[5]) + 0.10 * abs(v[6] - kv[6]) + 0.10 * abs(v[7] - kv[7]) + 0.14 * abs(90 * v[8] - 90 * kv[8]) / greatest(2000 + 90 * v[8], 2000 + 90 * kv[8], 200.0)
  + 0.06 * abs(v[9] - kv[9]) + 0.05 * abs(v[10] - kv[10]) / greatest(v[10], kv[10], 1.0) + 0.05 * abs(v[11] - kv[11])) AS x FROM f JOIN k USING (role, family) WHERE path <> keep_path)
SELECT group_id, keep_path, path, round(greatest(0.0, least(1.0, x)), 6) AS score, CASE WHEN x >= 0.94 THEN 'high' ELSE 'medium' END AS confidence FROM g WHERE greatest(0.0, least(1.0, x)) >= 0.6"""


# ---- registries and plans


def set_report(spark, d):
    return sets.registry(bed.library(spark, d))


SETS_SQL = f"""WITH {LIB}, c AS (SELECT split_part(path, '/', 1) AS set_root FROM lib WHERE path LIKE '%/project.work')
SELECT set_root, set_root AS set_name, set_root || '/AUDIO' AS audio_root, count(*) FILTER (WHERE path LIKE '%.work') AS projects, count(*) FILTER (WHERE path LIKE '%.strd') AS patterns, count(*) FILTER (WHERE path LIKE '%/AUDIO/%.wav') AS audio,
  (SELECT min(path) FROM lib WHERE path LIKE '%.txt') AS doc FROM c JOIN lib ON starts_with(path, set_root || '/') GROUP BY set_root"""


def source_registry(spark, d):
    return sets.sources(bed.library(spark, d))


SOURCES_SQL = f"""WITH {LIB}, c AS (SELECT split_part(path, '/', 1) AS set_root FROM lib WHERE path LIKE '%/project.work'), s AS (SELECT path, split_part(path, '/', 1) AS top, set_root FROM lib LEFT JOIN c ON starts_with(path, set_root || '/')),
k AS (SELECT path, top, CASE WHEN set_root IS NOT NULL AND regexp_matches(path, '[.](work|strd)$') THEN 'octatrack-set-project' WHEN set_root IS NOT NULL AND starts_with(path, set_root || '/AUDIO/') THEN 'octatrack-set-audio' WHEN path LIKE '%.txt' THEN 'document'
  WHEN NOT regexp_matches(path, '[.](wav|aif|flac|mp3|ogg)$') THEN NULL WHEN top = 'CURATED' THEN 'curated-sample' ELSE 'vendor-pack-audio' END AS source_kind FROM s)
SELECT path, source_kind, CASE WHEN top = 'PACKS' THEN split_part(path, '/', 2) ELSE top END AS source_name, '' AS processing_tag, '' AS processing_reason FROM k WHERE source_kind IS NOT NULL"""


def review_build(spark, d):
    return plans.review(bed.library(spark, d))


SCOPE = "regexp_matches(path, '[.](wav|aif|flac|mp3|ogg)$') AND split_part(path, '/', 1) <> 'CURATED'"
REVIEW = f"""{FILES}, {ROLE_CTE}, n AS ({_names_sql().replace(LOC, "loc AS (SELECT * FROM loc0)").replace("WITH ", "WITH loc0 AS (SELECT row_number() OVER (ORDER BY path) AS doc_id, path FROM lib), ", 1)}),
rv AS (SELECT path AS source, roles.role AS role, n.sample_type, coalesce(regexp_extract(path, '(?i)(?:^|[^0-9])([0-9]{{2,3}})\\s*bpm(?:[^0-9]|$)', 1), '') AS bpm1, coalesce(regexp_extract(path, '\\[([0-9]{{2,3}})\\]', 1), '') AS bpm2,
  CASE WHEN regexp_matches(path, 'loop|groove') THEN regexp_extract(path, '(?i)(?:^|[^a-z0-9])([6-9][0-9]|1[0-9][0-9]|200)(?:[^a-z0-9]|$)', 1) ELSE '' END AS bpm3, coalesce(n.musical_key, '') AS key, n.name AS proposed_name, confidence, reason FROM roles JOIN n USING (doc_id) WHERE {SCOPE}),
review AS (SELECT *, CASE WHEN bpm1 <> '' THEN bpm1 WHEN bpm2 <> '' THEN bpm2 ELSE bpm3 END AS bpm FROM rv)"""
_TOKEN = "coalesce(nullif(trim(regexp_replace(regexp_replace(replace(replace(lower(trim({0})), '''', ''), '&', 'and'), '[^a-z0-9._-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-_'), ''), 'sample')"
REVIEW_SQL = f"""WITH {REVIEW} SELECT source, role, sample_type, bpm, key, CASE WHEN bpm = '' THEN 'unknown' WHEN bpm::INT BETWEEN 130 AND 150 THEN 'techno-core' WHEN bpm::INT BETWEEN 124 AND 129 THEN 'techno-adjacent' WHEN bpm::INT < 124 THEN 'house-lower' ELSE 'too-fast' END AS tempo_fit,
  role || '/' || {_TOKEN.format("split_part(source, '/', 2)")} || '/' || proposed_name AS proposed_path, proposed_name, confidence, reason, CASE WHEN length(proposed_name) > 24 THEN 'digitakt-name>24' ELSE '' END AS warnings FROM review"""


def sort_plan(spark, d):
    return plans.sort_plan(bed.library(spark, d))


_NUMBERED = "CASE WHEN n > 1 THEN regexp_replace(dest, '^(.*)([.][^.]*)$', '\\1-' || n || '\\2') ELSE dest END"
SORT_SQL = f"""WITH {REVIEW}, p AS (SELECT source AS src, 'CURATED/' || role || '/' || proposed_name AS dest, role || '|' || reason AS tag FROM review WHERE role <> '_REVIEW'),
q AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY src) AS n FROM p) SELECT src, {_NUMBERED} AS dest, tag FROM q"""


def bucket_plan(spark, d):
    return plans.bucket_plan(bed.library(spark, d))


BUCKETS_SQL = f"""WITH {LIB}, b AS (SELECT path AS src, string_split(path, '/') AS parts, CASE WHEN regexp_matches(lower(path), 'loop|lp|groove|bpm') OR regexp_matches(lower(path), '[0-9]{{2,3}}\\s?bpm') THEN 'LOOPS'
  WHEN regexp_matches(lower(path), 'pad|drone|atmos|texture|swell|ambient') THEN 'PADS-DRONES' WHEN regexp_matches(lower(path), 'oneshot|one-shot|one_shot|one shot|hit|shot|stab|single') THEN 'ONE-SHOTS' ELSE 'OTHER' END AS bucket
  FROM lib WHERE regexp_matches(path, '[.](wav|aif|flac|mp3|ogg)$') AND split_part(path, '/', 1) <> 'PACKS')
SELECT src, bucket || '/' || CASE WHEN len(parts) >= 3 THEN array_to_string(parts[2:], '/') ELSE '_loose/' || parts[-1] END AS dest, bucket || '|' || CASE bucket WHEN 'LOOPS' THEN 'keyword:loop' WHEN 'PADS-DRONES' THEN 'keyword:pad' WHEN 'ONE-SHOTS' THEN 'keyword:oneshot' ELSE 'unmatched' END AS tag FROM b"""


def intake_plan(spark, d):
    return plans.intake_plan(bed.library(spark, d))


INTAKE_SQL = f"""WITH {LIB}, s AS (SELECT DISTINCT split_part(path, '/', 1) AS src FROM lib WHERE regexp_matches(path, '[.](wav|aif|flac|mp3|ogg)$')), t AS (SELECT src, 'PACKS/' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(src), '[a-z]{{2,4}}-[0-9]{{3,6}}', ' ', 'g'), '[.\\s_-]+'),
  lambda w: w <> '' AND w NOT IN ('multiformat', 'multi', 'wav', 'flac', 'aiff', 'aif', 'scd', 'mp3', 'samples', 'sample', 'decibel', 'pack') AND NOT regexp_matches(w, '^[0-9]{{3,6}}$')), '-') AS dest FROM s WHERE src NOT IN ('PACKS', 'CURATED')),
h AS (SELECT DISTINCT 'PACKS/' || split_part(path, '/', 2) AS dest FROM lib WHERE path LIKE 'PACKS/%')
SELECT src, CASE WHEN h.dest IS NOT NULL THEN t.dest || '-2' ELSE t.dest END AS dest, 'pack|' || src AS tag FROM t LEFT JOIN h USING (dest)"""


def plan_preview(spark, d):
    """What a plan that moves every curated file to the catalogue zone, or onto its neighbour, would do."""
    files = bed.library(spark, d)
    flat = F.regexp_replace("path", "^[^/]*/", "CATALOGUE/")
    plan = files.filter("path LIKE 'CURATED/%'").select(F.when(F.length("path") % 4 == 0, F.concat(F.lit("x"), "path")).otherwise(F.col("path")).alias("src"), F.when(F.length("path") % 3 == 0, F.col("path")).otherwise(flat).alias("dest"))
    return plans.preview(plan, files)


PREVIEW_SQL = f"""WITH {LIB}, p AS (SELECT CASE WHEN length(path) % 4 = 0 THEN 'x' || path ELSE path END AS src, CASE WHEN length(path) % 3 = 0 THEN path ELSE regexp_replace(path, '^[^/]*/', 'CATALOGUE/') END AS dest FROM lib WHERE path LIKE 'CURATED/%')
SELECT src, dest, CASE WHEN src NOT IN (SELECT path FROM lib) THEN 'missing' WHEN dest IN (SELECT path FROM lib) THEN 'exists' ELSE 'moved' END AS status FROM p"""


def pattern_export(spark, d):
    """A manifest of one glob, one folder and one file for each source."""
    src = spark.read.parquet(f"{d}/documents.parquet").select("source").filter("source IS NOT NULL").distinct()
    text = F.array(F.concat("source", F.lit(" WAV/*.wav")), F.concat(F.lit("PACKS/"), "source"), F.concat("source", F.lit(" WAV/ride.flac => My Ride")))
    lines = src.select("source", F.posexplode(text).alias("k", "value")).select((F.regexp_extract("source", "([0-9]+)$", 1).cast("long") * 3 + F.col("k")).alias("line"), "value")
    return plans.export_plan(plans.read_patterns(lines), bed.library(spark, d))[0]


EXPORT_SQL = f"""WITH {LIB}, s AS (SELECT DISTINCT source, regexp_extract(source, '([0-9]+)$', 1)::BIGINT * 3 AS n FROM documents WHERE source IS NOT NULL),
m AS (SELECT n AS line, path AS src, NULL AS rename FROM s JOIN lib ON starts_with(path, source || ' WAV/') AND path LIKE '%.wav' UNION ALL SELECT n + 1, path, NULL FROM s JOIN lib ON starts_with(path, 'PACKS/' || source || '/') UNION ALL SELECT n + 2, path, 'my-ride' FROM s JOIN lib ON path = source || ' WAV/ride.flac'),
o AS (SELECT line, src, coalesce(rename, {_TOKEN.format("regexp_replace(split_part(src, '/', -1), '[.][^.]*$', '')")}) || '.wav' AS dest FROM m),
q AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY line, src) AS n FROM o), r AS (SELECT line, src, CASE WHEN n > 1 THEN regexp_replace(dest, '^(.*)([.][^.]*)$', '\\1_' || n || '\\2') ELSE dest END AS out_name FROM q)
SELECT line, src, out_name, CASE WHEN length(out_name) > 24 THEN 'name >24 chars (will truncate on device)' ELSE '' END AS warnings FROM r"""


# ---- judgements


def _measured(spark, d):
    """Curated files with measures."""
    i = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, bed.FOLDERS)), (i % 10 + 1).cast("int"))
    s = _samples(spark, d).drop("role", "origin")
    path = F.concat_ws("/", F.lit("CURATED"), folder, F.element_at(paths.parts(_p()), -1))
    return s.select("doc_id", path.alias("path"), folder.alias("role"), *[c for c in s.columns if c not in ("doc_id", "path")]).withColumn("sample_type", names.sample_type(_p(), F.col("role")))


MEASURED = f"""{LOC}, {FEAT}, m AS (SELECT doc_id, ['KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC', 'DRUM-LOOPS', 'BASS', 'SYNTH-STAB-CHORD', 'DRONE-ATMOS', 'FX-RISE-IMPACT', 'VOCALS'][doc_id % 10 + 1] AS role, split_part(path, '/', -1) AS name,
  4 * abs(v[1]) AS duration_s, 5 * abs(v[2]) AS sub_ratio, 5 * abs(v[3]) AS low_ratio, 15000 * abs(v[5]) AS centroid_hz, 2000 * abs(v[6]) AS tail_ms, 10 * abs(v[7]) AS onset_density, 3 * abs(v[11]) AS flatness, 60 * abs(v[12]) AS attack_ms FROM loc LEFT JOIN (SELECT sample_id AS doc_id, v FROM feat) USING (doc_id))"""
_NUM = "'{0}=' || rtrim(rtrim(printf('%.2f', {0}), '0'), '.')"


def role_conflicts(spark, d):
    m = _measured(spark, d)
    c = analysis.role_conflict(_p(), F.col("sample_type"), F.col("duration_s"), F.col("tail_ms"))
    return m.select("path", c.alias("c")).filter("c IS NOT NULL").select("path", "c.*")


CONFLICTS_SQL = f"""WITH {MEASURED}, sig AS (SELECT * FROM (VALUES (1, 'KICKS', ['bassdrum', 'bass drum', 'bdrum', 'kick', 'kicks', 'bd']), (2, 'CLAP-SNARE', ['clap', 'claps', 'snare', 'snares', 'rim', 'sd', 'rs']),
  (3, 'HATS-CYM', ['hihat', 'hi hat', 'hat', 'hats', 'hh', 'cymbal', 'cym', 'ride', 'crash', 'shaker']),
  (4, 'PERC', ['perc', 'percussion', 'conga', 'bongo', 'tom', 'agogo', 'tribal', 'cabasa', 'cabassa', 'cow', 'clave', 'block', 'tamb', 'quijada', 'timbale', 'timb', 'tabla', 'triangle', 'guiro', 'maraca', 'whistle', 'finger', 'fingers']),
  (5, 'DRUM-LOOPS', ['drum loop', 'top loop', 'beat loop', 'loop', 'loops', 'groove', 'grooves']), (6, 'BASS', ['bass', 'reese']), (7, 'SYNTH-STAB-CHORD', ['synth', 'stab', 'chord', 'pluck', 'arp', 'lead', 'sh101', 'acid', 'guitar', 'keys', 'piano']),
  (8, 'DRONE-ATMOS', ['drone', 'drones', 'pad', 'pads', 'atmos', 'ambience', 'ambient', 'texture', 'textures', 'field']), (9, 'FX-RISE-IMPACT', ['fx', 'sfx', 'impact', 'riser', 'rise', 'uplifter', 'downlifter', 'sweep', 'swell', 'noise', 'scratch', 'door', 'chime']),
  (10, 'VOCALS', ['vocal', 'vocals', 'vox', 'voice', 'voices', 'acapella', 'accapella'])) t(k, other, words)),
x AS (SELECT m.*, regexp_replace(lower(name), '[_./-]', ' ', 'g') AS text, regexp_matches(name, '(?i)loop|groove|(^|[^0-9])[0-9]{{2,3}}\\s*bpm([^0-9]|$)|\\[[0-9]{{2,3}}\\]') AS loop FROM m),
h AS (SELECT doc_id, k, other, list_filter(words, lambda w: CASE WHEN contains(w, ' ') THEN contains(text, w) ELSE len(list_filter(regexp_split_to_array(text, '[^a-z0-9]+'), lambda t: starts_with(t, w))) > 0 END) AS hits FROM x, sig WHERE other <> role),
n AS (SELECT doc_id, list(other ORDER BY k) AS issues, flatten(list(list_transform(hits, lambda w: other || ':' || w) ORDER BY k)) AS reasons FROM h WHERE len(hits) > 0 GROUP BY doc_id),
y AS (SELECT x.*, coalesce(n.issues, []) AS issues, coalesce(n.reasons, []) AS reasons, role IN ('KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC') AS one FROM x LEFT JOIN n USING (doc_id)),
z AS (SELECT *, one AND loop AS l, one AND coalesce(duration_s > 3.0, false) AS long, one AND NOT coalesce(duration_s > 3.0, false) AND coalesce(tail_ms > 3000, false) AS tail FROM y),
o AS (SELECT 'CURATED/' || role || '/' || name AS path, role AS current_role, issues || (CASE WHEN l AND NOT list_contains(issues, 'DRUM-LOOPS') THEN ['DRUM-LOOPS'] ELSE [] END) || (CASE WHEN long OR tail THEN ['long-audio'] ELSE [] END) AS i,
  reasons || (CASE WHEN l THEN ['sample_type:loop'] ELSE [] END) || (CASE WHEN long THEN ['duration=' || printf('%.2f', duration_s) || 's'] ELSE [] END) || (CASE WHEN tail THEN ['tail_ms=' || rtrim(rtrim(printf('%.2f', tail_ms), '0'), '.')] ELSE [] END) AS r FROM z)
SELECT path, current_role, array_to_string(i, ';') AS issues, array_to_string(r, ';') AS reasons, 'review-or-quarantine' AS action FROM o WHERE len(i) > 0"""


def character_tags(spark, d):
    m = _measured(spark, d).withColumns({"duration": F.col("duration_s"), "bpm": F.coalesce(paths.bpm(_p()), F.lit("")), "processing_tag": names.processing_tag(_p()), "processing_reason": analysis.processing_reason(_p())})
    return m.select("doc_id", analysis.character_tags().alias("t")).select("doc_id", "t.*")


def _tags_sql() -> str:
    num, n2 = _NUM.format, "rtrim(rtrim(printf('%.2f', duration_s), '0'), '.')"
    rows = [
        ("KICKS", "'subby'", "sub_ratio >= 0.60", num("sub_ratio")), ("KICKS", "'short'", "tail_ms <= 250", num("tail_ms")),
        ("KICKS", "'rumble-long'", "tail_ms >= 700 AND low_ratio >= 0.55", num("tail_ms") + " || ';' || " + num("low_ratio")), ("KICKS", "'clicky'", "attack_ms <= 5", num("attack_ms")),
        ("KICKS", "'subby'", "contains(text, 'sub')", "'path:sub'"), ("KICKS", "'short'", "duration_s <= 0.75", "'duration=' || printf('%.2f', duration_s) || 's'"), ("KICKS", "'rumble-long'", "contains(text, 'rumble')", "'path:rumble'"),
        ("HATS-CYM", "'metallic'", "flatness >= 0.35 AND centroid_hz >= 3500", num("flatness") + " || ';' || " + num("centroid_hz")), ("HATS-CYM", "'tight'", "tail_ms <= 250", num("tail_ms")),
        ("HATS-CYM", "'metallic'", "contains(text, 'metal')", "'path:metallic'"), ("HATS-CYM", "'tight'", "regexp_matches(text, 'tight|closed') OR coalesce(duration_s <= 0.35, false)", "coalesce('duration=' || printf('%.2f', duration_s) || 's', 'path:tight')"),
        ("PERC", "'wood'", "regexp_matches(text, 'wood|clave|block')", "'path:wood-family'"), ("PERC", "'tribal'", "regexp_matches(text, 'tribal|conga|tom|cowbell')", "'path:tribal-family'"),
        ("DRUM-LOOPS", "'sparse'", "duration_s >= 1.0 AND onset_density <= 2.0", num("onset_density")), ("DRUM-LOOPS", "'busy'", "duration_s >= 1.0 AND onset_density >= 8.0", num("onset_density")),
        ("DRUM-LOOPS", "'sparse'", "contains(text, 'sparse')", "'path:sparse'"), ("DRUM-LOOPS", "'busy'", "contains(text, 'busy')", "'path:busy'"),
        ("DRONE-ATMOS", "'dub-wash'", "duration_s >= 5.0 AND onset_density <= 1.5 AND centroid_hz <= 1200", f"'duration=' || {n2} || 's;' || " + num("onset_density") + " || ';' || " + num("centroid_hz")), ("DRONE-ATMOS", "'dub-wash'", "regexp_matches(text, 'dub|wash')", "'path:dub/wash'"),
        ("DRUM-LOOPS", "'top-' || bpm", "contains(text, 'top') AND bpm <> ''", "'path:top;bpm=' || bpm"),
    ]
    hits = ", ".join(f"CASE WHEN role = '{r}' AND ({test}) THEN {{'tag': {t}, 'reason': {why}}} END" for r, t, test, why in rows)
    bare = "CASE WHEN regexp_matches(path, 'loop|groove') THEN regexp_extract(path, '(?i)(?:^|[^a-z0-9])([6-9][0-9]|1[0-9][0-9]|200)(?:[^a-z0-9]|$)', 1) END"
    return f"""WITH {MEASURED}, p AS (SELECT *, 'CURATED/' || role || '/' || name AS path FROM m), b AS (SELECT *, regexp_replace(lower(path), '[_-]', ' ', 'g') AS text,
  coalesce(nullif(regexp_extract(path, '(?i)(?:^|[^0-9])([0-9]{{2,3}})\\s*bpm(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(path, '\\[([0-9]{{2,3}})\\]', 1), ''), {bare}, '') AS bpm FROM p),
h AS (SELECT doc_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM b), f AS (SELECT doc_id, list_filter(hits, lambda x, i: list_position(list_transform(hits, lambda y: y.tag), x.tag) = i) AS hits FROM h)
SELECT doc_id, array_to_string(list_transform(hits, lambda x: x.tag), ';') AS tags, array_to_string(list_transform(hits, lambda x: x.reason), ';') AS reasons FROM f"""


def _votes(spark, d):
    i = F.col("doc_id")
    classes = F.array(*map(F.lit, ("kick", "snr", "hhc", "cow", "bass", "zap", "tom")))
    v = spark.read.parquet(f"{d}/documents.parquet").select(i, F.get(F.array(*map(F.lit, bed.FOLDERS)), (i % 10).cast("int")).alias("current_role"), F.get(classes, (i % 7).cast("int")).alias("top_class"), (i % 100 / 100).alias("top_prob"))
    return audit.derive(v.withColumn("path", F.concat(F.lit("CURATED/"), "current_role", F.lit("/pack"), (F.col("doc_id") % 9).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))))


VOTES = """v AS (SELECT doc_id, ['KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC', 'DRUM-LOOPS', 'BASS', 'SYNTH-STAB-CHORD', 'DRONE-ATMOS', 'FX-RISE-IMPACT', 'VOCALS'][doc_id % 10 + 1] AS current_role, ['kick', 'snr', 'hhc', 'cow', 'bass', 'zap', 'tom'][doc_id % 7 + 1] AS top_class,
  ['KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC', 'BASS', 'REVIEW', 'PERC'][doc_id % 7 + 1] AS suggested_role, (doc_id % 100)::DOUBLE / 100 AS top_prob FROM documents),
w AS (SELECT *, current_role IN ('KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC') AS auth, CASE WHEN top_prob >= 0.8 THEN 'trust' WHEN top_prob >= 0.5 THEN 'review' ELSE 'low' END AS band FROM v)"""


def role_audit(spark, d):
    return audit.summary(_votes(spark, d))


AUDIT_SQL = f"""WITH {VOTES} SELECT current_role, count(*) AS files, count(*) FILTER (WHERE auth AND suggested_role <> current_role) AS mismatched, count(*) FILTER (WHERE auth AND suggested_role <> current_role AND band = 'trust') AS high_confidence,
  count(*) FILTER (WHERE auth AND suggested_role = current_role) AS agreeing, count(*) FILTER (WHERE NOT auth AND band = 'trust' AND suggested_role IN ('KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC')) AS flagged FROM w GROUP BY current_role"""


def trust_mismatches(spark, d):
    m = audit.mismatches(_votes(spark, d))
    return m.select("candidate_id", "path", "current_role", "suggested_role", "source_group")


MISMATCH_SQL = f"""WITH {VOTES}, m AS (SELECT *, 'CURATED/' || current_role || '/pack' || doc_id % 9 || '/' || doc_id || '.wav' AS path FROM w WHERE auth AND suggested_role <> current_role AND band = 'trust')
SELECT sha256(path || chr(0) || current_role || chr(0) || suggested_role)[1:12] AS candidate_id, path, current_role, suggested_role, 'pack' || doc_id % 9 AS source_group FROM m"""


def calibration_picks(spark, d):
    return audit.calibration(audit.mismatches(_votes(spark, d)), 5).select("current_role", "suggested_role", "path")


_PICK = "{'path': path, 'p': top_prob, 'g': source_group}"
_SEEN = "list_contains(list_transform(chosen, lambda x: x.g), source_group)"
_FAR = "list_min(list_transform(chosen, lambda x: abs(x.p - top_prob)))"
CALIBRATION_SQL = f"""WITH RECURSIVE {VOTES}, m AS (SELECT *, 'CURATED/' || current_role || '/pack' || doc_id % 9 || '/' || doc_id || '.wav' AS path, 'pack' || doc_id % 9 AS source_group FROM w
  WHERE auth AND suggested_role <> current_role AND band = 'trust'),
r AS (SELECT 1 AS i, current_role, suggested_role, [first({_PICK} ORDER BY top_prob, path)] AS chosen FROM m GROUP BY current_role, suggested_role
  UNION ALL SELECT i + 1, current_role, suggested_role, list_append(first(chosen), first({_PICK} ORDER BY {_SEEN}, -{_FAR}, path)) FROM r JOIN m USING (current_role, suggested_role)
  WHERE i < 5 AND NOT list_contains(list_transform(chosen, lambda x: x.path), path) GROUP BY i, current_role, suggested_role),
l AS (SELECT current_role, suggested_role, first(chosen ORDER BY i DESC) AS chosen FROM r GROUP BY current_role, suggested_role)
SELECT current_role, suggested_role, unnest(list_transform(chosen, lambda x: x.path)) AS path FROM l"""


def mismatch_routes(spark, d):
    return audit.routes(audit.mismatches(_votes(spark, d)))


ROUTES_SQL = f"""WITH {VOTES} SELECT list_position(['KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC'], current_role) AS place, current_role, suggested_role, count(*) AS n FROM w WHERE auth AND suggested_role <> current_role AND band = 'trust' GROUP BY ALL"""


def benchmark_scorecard(spark, d):
    v = _votes(spark, d).withColumn("true_role", F.when(F.col("doc_id") % 4 == 0, F.col("current_role")).otherwise(F.col("suggested_role")))
    pairs = benchmark.truth(v.select("path", "true_role"), v.filter("doc_id % 6 <> 0").select("path", F.col("current_role").alias("predicted")))
    card = benchmark.scorecard(pairs)
    return card.select("place", "role", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "total")


SCORE_SQL = f"""WITH {VOTES}, d AS (SELECT ['KICKS', 'CLAP-SNARE', 'HATS-CYM', 'PERC', 'DRONE-ATMOS', 'VOCALS', 'OTHER'] AS roles),
t0 AS (SELECT CASE WHEN doc_id % 4 = 0 THEN current_role ELSE suggested_role END AS a, CASE WHEN doc_id % 6 <> 0 THEN current_role END AS b, roles FROM w, d), t AS (SELECT CASE WHEN list_contains(roles, a) THEN a ELSE 'OTHER' END AS truth, CASE WHEN list_contains(roles, coalesce(b, '')) THEN b ELSE 'OTHER' END AS predicted FROM t0),
r AS (SELECT unnest(roles) AS role, unnest(range(1, 8)) AS place FROM d), s AS (SELECT place, role, (SELECT count(*) FROM t WHERE truth = role) AS support, (SELECT count(*) FROM t WHERE truth = role AND predicted = role) AS tp, (SELECT count(*) FROM t WHERE predicted = role) AS named FROM r),
p AS (SELECT place, role, support, CASE WHEN named > 0 THEN tp / named::DOUBLE ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END AS r FROM s)
SELECT place, role, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, (SELECT round(avg((truth = predicted)::INT), 6) FROM t) AS accuracy, (SELECT count(*) FROM t) AS total FROM p"""


# ---- search and curation


def _index(spark, d):
    s = _samples(spark, d)
    s = s.withColumn("sample_id", F.sha2(F.col("doc_id").cast("string"), 256))
    hits = tags.apply_rules(s, RULES).select("sample_id", "tag_group", "tag")
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type <> 'error'").groupBy(F.sha2(F.col("user_id").cast("string"), 256).alias("sample_id")).agg(F.count("*").alias("picks"))
    return find.index(s.select("sample_id", "path"), s.filter("doc_id % 3 <> 0").select("sample_id", "origin"), hits, e)


INDEX = f"""{HITS}, t AS (SELECT doc_id, list_sort(list_distinct(list(tag))) AS tags FROM hits GROUP BY doc_id), pk AS (SELECT user_id AS doc_id, count(*) AS picks FROM events WHERE event_type <> 'error' GROUP BY 1),
ix AS (SELECT sha256(doc_id::VARCHAR) AS sample_id, path, role, CASE WHEN doc_id % 3 <> 0 THEN origin ELSE 'unknown' END AS origin, coalesce(tags, []) AS tags, coalesce(picks, 0) AS picks FROM samples LEFT JOIN t USING (doc_id) LEFT JOIN pk USING (doc_id))"""


def search_run(spark, d):
    """The most picked samples that are dark or loops, of those not in a pack's first source."""
    got = find.run(tags.search(_index(spark, d), ("dark", "loop"), any_=True), "picks", 40)
    return got.select("place", "total", "sample_id", "path", "role", "origin", F.array_join("tags", ";").alias("tags"), "picks")


SEARCH_SQL = f"""{INDEX}, f AS (SELECT * FROM ix WHERE regexp_matches(lower(path) || ' ' || array_to_string(tags, ' ') || ' ' || origin, 'dark|loop')), r AS (SELECT *, row_number() OVER (ORDER BY picks DESC, path) AS place, count(*) OVER () AS total FROM f)
SELECT place, total, sample_id, path, role, origin, array_to_string(tags, ';') AS tags, picks FROM r WHERE place <= 40"""


def search_spread(spark, d):
    got = find.run(tags.search(_index(spark, d), (), {"role": ("kicks", "bass")}), "spread", 60)
    return got.select("place", "total", "sample_id", "origin", "path")


SPREAD_SQL = f"""{INDEX}, f AS (SELECT *, array_to_string(list_filter(string_split(split_part(regexp_replace(split_part(path, '/', -1), '[.][^.]*$', ''), '_', 1), '-'), lambda w: w <> '')[1:3], '-') AS fam FROM ix WHERE role IN ('KICKS', 'BASS')),
g AS (SELECT *, row_number() OVER (PARTITION BY origin, fam ORDER BY path) AS turn, count(*) OVER () AS total FROM f), r AS (SELECT *, row_number() OVER (ORDER BY turn, origin, fam) AS place FROM g) SELECT place, total, sample_id, origin, path FROM r WHERE place <= 60"""


def search_like(spark, d):
    """The nearest to one sample, found by a part of its path."""
    f = bed.features(spark, d)
    rows = f.select("sample_id", F.concat(F.lit("PACKS/"), "role", F.lit("/v"), F.col("sample_id").cast("string"), F.lit(".wav")).alias("path"))
    got = find.run(rows, "like", 25, like="/v11.", vectors=f)
    return got.select("place", "total", "sample_id", "path", F.round("distance", 6).alias("distance"))


LIKE_SQL = f"""WITH {FEAT}, u AS (SELECT unnest(range(1, 17)) AS i), m AS (SELECT i, min(v[i]) AS lo, max(v[i]) AS hi FROM feat, u GROUP BY i), x AS (SELECT list(lo ORDER BY i) AS low, list(CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END ORDER BY i) AS span FROM m),
s AS (SELECT f.sample_id, 'PACKS/' || f.role || '/v' || f.sample_id || '.wav' AS path, list_filter(list_transform(range(1, 17), lambda i: pow((f.v[i] - low[i]) / span[i] - (t.v[i] - low[i]) / span[i], 2)), lambda g: g IS NOT NULL) AS gaps FROM feat f, (SELECT v FROM feat WHERE sample_id = 11) t, x),
r AS (SELECT *, row_number() OVER (ORDER BY sqrt(list_sum(gaps) / len(gaps)), path) AS place FROM s WHERE len(gaps) > 0) SELECT place, (SELECT count(*) FROM feat) AS total, sample_id, path, round(sqrt(list_sum(gaps) / len(gaps)), 6) AS distance FROM r WHERE place <= 25"""


def promotion_gates(spark, d):
    """Everything that stands in the way of a label sheet with planted faults."""
    i = F.col("doc_id")
    loc = bed.locations(spark, d)
    some = loc.filter(i % 2 == 0)
    role = ladders.instrument(_p())
    sheet = some.select(i.alias("row"), F.when(i % 22 == 0, F.substring("sample_id", 1, 12)).otherwise(F.col("sample_id")).alias("sample_id"), _p().alias("current_path"), F.when(i % 4 == 0, "favourite").otherwise("keep").alias("decision"), role.alias("true_role"), names.descriptor(_p()).alias("descriptor"), F.lit("").alias("tags"))
    scan = loc.filter(i % 14 != 0).select("path", "sample_id")
    now = loc.select("path", F.when(i % 26 == 0, F.sha2(_p(), 256)).otherwise(F.col("sample_id")).alias("sample_id"))
    packet, latest = spark.sql("SELECT 'scan-1' AS scan_id, '/lib' AS root"), spark.sql("SELECT 'scan-2' AS scan_id, '/lib' AS root")
    return curation.promote(sheet, packet, latest, scan, now)[1]


GATES_SQL = f"""WITH {LOC}, {ROLE_CTE}, i AS (SELECT doc_id, path, sample_id, CASE WHEN doc_id % 22 = 0 THEN sample_id[1:12] ELSE sample_id END AS label_id, ' ' || replace(replace(replace(lower(path), '/', ' '), '_', ' '), '-', ' ') || ' ' AS t FROM loc WHERE doc_id % 2 = 0),
k AS (SELECT *, regexp_matches(t, 'open hat|openh|ohh|closed hat|closedh|chh|drum loop|top loop|beat loop|bass loop|bassloop|synth loop|chord loop|vocal loop|vox loop|texture|drone|atmos|ambient|kick|bassdrum|bass drum| bd |snare| sd |clap|rim|shaker|ride|cymbal| cym |crash|tom|perc|conga|bongo|cowbell|clave|bass|sub|reese|stab|chord|synth|pluck| fx |impact|riser|noise|vocal|vox|voice') AS known FROM i)
SELECT NULL::BIGINT AS row, 'stale packet: a newer scan exists' AS violation UNION ALL SELECT doc_id, 'invalid sample_id' FROM k WHERE length(label_id) <> 64 UNION ALL SELECT doc_id, 'favourite without a role' FROM k WHERE doc_id % 4 = 0 AND NOT known
UNION ALL SELECT doc_id, CASE WHEN doc_id % 14 = 0 OR label_id <> sample_id THEN 'stale or missing source' ELSE 'hash changed since the scan' END FROM k WHERE doc_id % 14 = 0 OR label_id <> sample_id OR doc_id % 26 = 0"""


# ---- state, signals, clusters


def scan_history(spark, d):
    """Locations after the last of two scans of the library: the first saw all but every ninth path, the second all but every
    seventh, some with other bytes."""
    files = bed.library(spark, d).withColumn("n", F.length("path"))
    row = lambda df, salt: df.select("path", F.sha2(F.concat("path", F.lit(salt)), 256).alias("sample_id"), F.col("n").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ms"))
    first = row(files.filter("n % 9 <> 0"), "a")
    empty = first.limit(0).withColumn("scan_id", F.lit("")).withColumn("exists_now", F.lit(True))
    return catalog.finish_scan(catalog.finish_scan(empty, first, "one"), row(files.filter("n % 7 <> 0"), "b"), "two")


HISTORY_SQL = f"""WITH {LIB} SELECT path, sha256(path || CASE WHEN length(path) % 7 <> 0 THEN 'b' ELSE 'a' END) AS sample_id, length(path) AS size, 0::BIGINT AS mtime_ms, CASE WHEN length(path) % 7 <> 0 THEN 'two' ELSE 'one' END AS scan_id, length(path) % 7 <> 0 AS exists_now
FROM lib WHERE length(path) % 7 <> 0 OR length(path) % 9 <> 0"""


def signal_features(spark, d):
    """The 16 measures of a signal for each label: its vectors one after the other."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id IS NOT NULL")
    part = F.floor(F.col("vec_id") / 50)
    s = e.groupBy("label", part.alias("part")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("signal"))
    waves = s.select(F.concat_ws("-", "label", "part").alias("path"), F.lit(640).alias("rate"), "signal", F.lit(None).cast("string").alias("error"))
    got = signals.features(waves, "path")
    return got.select("path", *[F.round(m, 6).alias(m) for m in signals.MEASURES])


def long_signals(spark, d):
    """The measures in time of one signal a label, all its vectors one after the other, in blocks of eight vectors."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id IS NOT NULL")
    e = select.numbered(e, ["label"], ["vec_id"], "_n").withColumn("block", F.floor((F.col("_n") - 1) / 8))
    blocks = e.groupBy(F.col("label").cast("string").alias("path"), "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "embedding"))), lambda x: x["embedding"])).alias("samples"))
    got = signals.block_features(blocks.withColumn("rate", F.lit(640)), "path", 512, 512)
    return got.select("path", *[F.round(m, 4).alias(m) for m in ("duration_s", "peak", "rms", "crest", "attack_ms", "tail_ms", "head_silence_ms", "tail_silence_ms", "zcr")])


LONG_SQL = """WITH x AS (SELECT label::VARCHAR AS path, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, embedding FROM embeddings WHERE vec_id IS NOT NULL),
s AS (SELECT path, 64 * r + j - 1 AS i, embedding[j] AS v, abs(embedding[j]) AS a FROM x, range(1, 65) t(j)), p AS (SELECT path, count(*) AS n, max(a) AS peak, sqrt(avg(v::DOUBLE * v)) AS rms FROM s GROUP BY path),
c AS (SELECT path, (v < 0) <> lag(v < 0) OVER (PARTITION BY path ORDER BY i) AS z FROM s), q AS (SELECT path, count(*) FILTER (WHERE z) AS z FROM c GROUP BY path),
w AS (SELECT path, min(i) FILTER (WHERE a >= (peak::DOUBLE * 0.01)::FLOAT) AS f, max(i) FILTER (WHERE a >= (peak::DOUBLE * 0.01)::FLOAT) AS l, min(i) FILTER (WHERE a >= peak) AS t, min(i) FILTER (WHERE a >= (peak::DOUBLE * 0.9)::FLOAT) AS h FROM s JOIN p USING (path) GROUP BY path)
SELECT path, round(n / 640.0, 4)::DOUBLE AS duration_s, round(peak::DOUBLE, 4) AS peak, round(rms, 4) AS rms, round(peak::DOUBLE / rms, 4) AS crest, round((h - f) / 0.64, 4)::DOUBLE AS attack_ms, round((l - t) / 0.64, 4)::DOUBLE AS tail_ms,
  round(f / 0.64, 4)::DOUBLE AS head_silence_ms, round((n - 1 - l) / 0.64, 4)::DOUBLE AS tail_silence_ms, round(z::DOUBLE / (n - 1), 4) AS zcr FROM p JOIN q USING (path) JOIN w USING (path)"""


def analysis_report(spark, d):
    """Counts of a whole run over the library: kinds, roles, crates, clusters, issues and gates."""
    src = staged(sets.sources(bed.library(spark, d)), "sources").withColumn("_v", F.pmod(F.xxhash64("path"), F.lit(500)))
    f = bed.features(spark, d).select(F.col("sample_id").alias("_v"), F.col("v").alias("x"))
    unit = {"duration_s": (1, 4), "rms": (2, 1), "crest": (3, 9), "attack_ms": (5, 40), "tail_ms": (6, 900), "centroid_hz": (7, 9000), "flatness": (8, 1), "sub_ratio": (9, 2), "low_ratio": (10, 2), "mid_ratio": (11, 1), "high_ratio": (12, 1), "onset_density": (13, 6), "zcr": (14, 1)}
    measures = src.join(f, "_v").select("path", *[(F.abs(F.col("x")[i - 1]) * k).alias(n) for n, (i, k) in unit.items()], F.lit("").alias("audio_error"))
    rows = report.feature_rows(src.drop("_v"), measures)
    groups = report.cluster_report(rows)
    return report.counts(rows, groups, report.crates(rows, groups, sets.registry(bed.library(spark, d))))


QUERIES = {f.__name__: f for f in (
    near_dup_groups, set_report, source_registry, review_build, sort_plan, bucket_plan, intake_plan, plan_preview, pattern_export, role_conflicts, character_tags, role_audit, trust_mismatches, calibration_picks,
    mismatch_routes, benchmark_scorecard, search_run, search_spread, search_like, promotion_gates, scan_history, signal_features, long_signals, analysis_report,
)}

ORACLE_SQL = {
    "near_dup_groups": NEAR_SQL, "set_report": SETS_SQL, "source_registry": SOURCES_SQL, "review_build": REVIEW_SQL, "sort_plan": SORT_SQL, "bucket_plan": BUCKETS_SQL, "intake_plan": INTAKE_SQL, "plan_preview": PREVIEW_SQL,
    "pattern_export": EXPORT_SQL, "role_conflicts": CONFLICTS_SQL, "character_tags": _tags_sql(), "role_audit": AUDIT_SQL, "trust_mismatches": MISMATCH_SQL, "mismatch_routes": ROUTES_SQL, "benchmark_scorecard": SCORE_SQL,
    "calibration_picks": CALIBRATION_SQL, "search_run": SEARCH_SQL, "search_spread": SPREAD_SQL, "search_like": LIKE_SQL, "promotion_gates": GATES_SQL, "scan_history": HISTORY_SQL, "long_signals": LONG_SQL,
}
