"""Queries of naming, origins, tags, search, gates and curation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratelake import bed
from cratelake.bed import LOC
from cratelake.functions import names, paths
from cratelake.operators import cluster, ladders, plans, select, tags
from cratelake.operators.vocabulary import QUOTAS, RULES
from cratelake.queries import INSTRUMENT_SQL, QUOTED, ROLE_CTE, ZONE

STEM = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
NUMBERS = {"duration_s": (1, 4), "sub_ratio": (2, 5), "low_ratio": (3, 5), "high_ratio": (4, 2), "centroid_hz": (5, 15000), "tail_ms": (6, 2000), "onset_density": (7, 10), "zcr": (8, 1), "crest": (9, 30), "mid_ratio": (10, 3), "flatness": (11, 3), "attack_ms": (12, 60)}


def _p():
    return F.col("path")


def _norm(x: str) -> str:
    s = f"regexp_replace(replace(replace(lower(trim({x})), '''', ''), '&', 'and'), '[^a-z0-9._-]+', '-', 'g')"
    return f"coalesce(nullif(trim(regexp_replace(regexp_replace({s}, '-{{2,}}', '-', 'g'), '_{{2,}}', '_', 'g'), '-_'), ''), 'sample')"


def _any(text: str, words: tuple) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def bucket_classify(spark, d):
    to = names.bucket(_p())
    return bed.locations(spark, d).select("doc_id", to.alias("bucket"), names.bucket_path(_p(), to).alias("dest"))


_BUCKET = f"""CASE WHEN {_any("lower(path)", names.LOOP_KEYWORDS)} OR regexp_matches(lower(path), '[0-9]{{2,3}}\\s?bpm') THEN 'LOOPS' WHEN {_any("lower(path)", names.PAD_KEYWORDS)} THEN 'PADS-DRONES'
  WHEN {_any("lower(path)", names.ONE_SHOT_KEYWORDS)} THEN 'ONE-SHOTS' ELSE 'OTHER' END"""
BUCKET_SQL = f"WITH {LOC}, b AS (SELECT doc_id, path, {_BUCKET} AS bucket FROM loc) SELECT doc_id, bucket, bucket || '/' || array_to_string(string_split(path, '/')[2:], '/') AS dest FROM b"


def proposed_names(spark, d):
    loc = bed.locations(spark, d).withColumn("role", ladders.role(_p())["role"])
    return loc.select(
        "doc_id", "role", names.sample_type(_p(), F.col("role")).alias("sample_type"), names.musical_key(paths.stem(_p())).alias("musical_key"), names.description(paths.stem(_p())).alias("description"),
        names.proposed_name(_p(), F.col("role")).alias("name"), names.export_role(F.col("role"), _p()).alias("export_role"), names.descriptor(_p()).alias("descriptor"), names.pack_slug(paths.stem(_p())).alias("slug"),
        names.family(_p()).alias("family"),
    )


def _description(stem: str) -> str:
    s = f"regexp_replace({stem}, '(?i)(^|[^0-9])[0-9]{{2,3}}\\s*bpm([^0-9]|$)', '\\1\\2', 'g')"
    s = f"regexp_replace({s}, '\\[[0-9]{{2,3}}\\]', '', 'g')"
    for _ in range(2):  # neighbours share a boundary
        s = f"regexp_replace({s}, '(?i)(^|[^a-z0-9])(?:[6-9][0-9]|1[0-9][0-9]|200)([^a-z0-9]|$)', '\\1\\2', 'g')"
    s = f"regexp_replace({s}, '{names.IN_KEY}', '', 'g')"
    s = f"regexp_replace({s}, '{names.NAMED_KEY}', '', 'g')"
    words = f"list_filter(regexp_split_to_array(lower({s}), '[^a-z0-9#b]+'), lambda w: w <> '' AND NOT list_contains({QUOTED(names.FORMAT_WORDS)}, w))"
    return _norm(f"array_to_string({words}, '-')")


def _drop(prefix: str) -> str:
    return "CASE " + " ".join(f"WHEN description = '{w}' THEN 'sample' WHEN starts_with(description, '{w}-') THEN substr(description, {len(w) + 2})" for w in prefix.split("-")) + " ELSE description END"


def _names_sql() -> str:
    text = "replace(replace(replace(lower(path), '_', ' '), '.', ' '), '/', ' / ')"
    bpm = f"""coalesce(nullif(regexp_extract(path, '(?i)(?:^|[^0-9])([0-9]{{2,3}})\\s*bpm(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(path, '\\[([0-9]{{2,3}})\\]', 1), ''),
      CASE WHEN contains({text}, 'loop') OR contains({text}, 'groove') THEN nullif(regexp_extract(path, '(?i)(?:^|[^a-z0-9])([6-9][0-9]|1[0-9][0-9]|200)(?:[^a-z0-9]|$)', 1), '') END)"""
    key = "list_filter(regexp_extract_all(stem, '(?i)(?:^|[^a-z])([a-g](?:#|b)?(?:\\s*(?:maj|min|major|minor|m))?)(?:[^a-z]|$)', 1), lambda x: length(x) > 1)[1]"
    note, mode = "lower(replace(regexp_extract(k, '(?i)^[a-g](#|b)?'), '#', 's'))", "lower(regexp_extract(k, '(?i)(maj|min|major|minor|m)$', 1))"
    refine = " ".join(f"WHEN role = '{r}' AND {_any('bare', ws)} THEN '{to}'" for r, steps in names.REFINEMENTS.items() for to, ws in steps)
    export = " ".join(f"WHEN role = '{r}' THEN '{to}'" for r, to in names.EXPORT_ROLES.items())
    bare = "CASE " + " ".join(f"WHEN starts_with(file, '{p}') THEN substr(file, {len(p) + 1})" for p in names.NAME_PREFIXES) + " ELSE file END"
    short = "CASE " + " ".join(f"WHEN role = '{r}' THEN '{p}-' || {_drop(p)}" for r, p in names.ROLE_PREFIX.items()) + f" ELSE 'review-' || {_drop('review')} END || '_' || source"
    longest = lambda ws: f"list_filter({ws}, lambda w: length(w) = list_max(list_transform({ws}, lambda x: length(x))))[1]"
    return f"""WITH {LOC}, {ROLE_CTE},
a AS (SELECT doc_id, path, role, {STEM} AS stem, {text} AS text, {bpm} AS bpm, {_norm("split_part(path, '/', 2)")} AS source, lower(split_part(path, '/', -1)) AS file FROM roles),
b AS (SELECT *, {key} AS k, {_description("stem")} AS description, {_description("CASE WHEN stem = lower(stem) THEN split_part(stem, '_', 1) ELSE stem END")} AS own, {bare} AS bare FROM a),
c AS (SELECT *, CASE WHEN k IS NOT NULL THEN {note} || CASE WHEN {mode} IN ('m', 'min', 'minor') THEN 'm' ELSE '' END END AS musical_key,
  list_filter(string_split(own, '-'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')) AS words FROM b),
e AS (SELECT *, list_filter(words, lambda w: length(w) >= 3) AS long, list_filter(words, lambda w: length(w) >= 3 AND NOT list_contains({QUOTED(names.ROLE_WORDS)}, w)) AS useful FROM c)
SELECT doc_id, role, CASE WHEN contains(text, 'loop') OR contains(text, 'groove') OR bpm IS NOT NULL THEN 'loop' WHEN role = 'DRONE-ATMOS' THEN 'texture' WHEN list_contains({QUOTED(names.ONE_SHOT_ROLES)}, role) THEN 'one-shot' ELSE 'unknown' END AS sample_type,
  musical_key, description, CASE WHEN role = 'DRUM-LOOPS' OR contains(text, 'loop') THEN {_norm("concat_ws('_', bpm, musical_key, description, source)")} ELSE {_norm(short)} END || lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS name,
  CASE {refine} {export} ELSE 'PERC' END AS export_role, coalesce({longest("useful")}, {longest("long")}, words[1], 'sample')[1:8] AS descriptor,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(stem), '[a-z]{{2,4}}-[0-9]{{3,6}}', ' ', 'g'), '[.\\s_-]+'), lambda w: w <> '' AND NOT list_contains({QUOTED(names.PACK_NOISE)}, w) AND NOT regexp_matches(w, '^[0-9]{{3,6}}$')), '-') AS slug,
  array_to_string(list_filter(string_split(split_part(stem, '_', 1), '-'), lambda w: w <> '')[1:3], '-') AS family
FROM e"""


def _flat(spark, d):
    """Every second path flattened, so that only the name tells the origin."""
    flat = F.concat_ws("/", paths.zone(_p()), F.lit("samples/loops"), F.element_at(paths.parts(_p()), -1))
    return bed.locations(spark, d).withColumn("path", F.when(F.col("doc_id") % 2 == 0, flat).otherwise(_p()))


def origin_resolve(spark, d):
    return tags.resolve_origins(_flat(spark, d))


#: The names that tell nothing of an origin, as they are compared.
STRUCTURAL = (
    "samples", "sample", "audio", "wav", "wavs", "aiff", "loops", "one-shots", "oneshots", "hits", "sounds", "files", "loose", "misc", "new", "old", "sorted", "unsorted",
    "packs", "catalogue", "curated", "presets", "midi", "legacy", "review", "export", "to-delete", "quarantine", "00_inbox", "drum-kits",
    "kicks", "clap-snare", "hats-cym", "perc", "drum-loops", "bass", "synth-stab-chord", "drone-atmos", "fx-rise-impact", "vocals",
)


def _origin_sql() -> str:
    s = QUOTED(STRUCTURAL)
    alias = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tags.ALIASES.items())
    of = lambda t: f"coalesce(CASE {t} {alias} END, CASE WHEN {t} <> '' AND NOT list_contains({s}, {t}) THEN replace({_norm(t)}, '_', '-') END)"
    folder = f"list_filter(list_transform(string_split(path, '/')[2:-2], lambda x: {{'o': {of(_norm('x'))}, 't': x}}), lambda f: f.o IS NOT NULL)[1]"
    bare = lambda t: f"regexp_replace({t}, '-[0-9]+$', '')"
    got = lambda o, c, m, t: f"CASE WHEN {o} IS NOT NULL THEN {{'origin': {o}, 'confidence': '{c}', 'method': '{m}', 'token': {t}}} END"
    return f"""WITH {LOC}, f AS (SELECT sample_id, CASE WHEN doc_id % 2 = 0 THEN {ZONE} || '/samples/loops/' || split_part(path, '/', -1) ELSE path END AS path FROM loc),
g AS (SELECT *, {STEM} AS stem FROM f), h AS (SELECT *, {folder} AS folder, CASE WHEN stem = lower(stem) AND contains(stem, '_') THEN substr(stem, strpos(stem, '_') + 1) ELSE '' END AS own FROM g),
v AS (SELECT own AS token FROM h WHERE own <> '' AND NOT regexp_matches(split_part(stem, '_', 1), '^([0-9]{{2,3}}|[a-g][sb]?m?)$') GROUP BY own HAVING count(*) >= 3),
n AS (SELECT path, arg_max(token, length(token)) AS known FROM h JOIN v ON ends_with(stem, '_' || token) WHERE folder IS NULL AND stem = lower(stem) GROUP BY path),
b AS (SELECT sample_id, path, coalesce({got("folder.o", "exact", "path-folder", "folder.t")}, {got(of(bare("known")), "parsed", "filename-token", "known")}, {got(of(bare("own")), "guessed", "filename-token-fallback", "own")},
  {{'origin': 'unknown', 'confidence': 'none', 'method': CASE WHEN own <> '' THEN 'generic-token' ELSE 'no-token-in-filename' END, 'token': ''}}) AS best FROM h LEFT JOIN n USING (path)),
w AS (SELECT sample_id, arg_min(best, (list_position(['exact', 'parsed', 'guessed', 'none'], best.confidence), path)) AS best FROM b GROUP BY sample_id)
SELECT sample_id, best.origin AS origin, best.confidence AS confidence, best.method AS method, best.token AS token FROM w"""


def _samples(spark, d):
    loc = bed.locations(spark, d).select("doc_id", "path", F.get(paths.parts(_p()), F.lit(1)).alias("origin"), ladders.role(_p())["role"].alias("role"))
    f = bed.features(spark, d)
    f = f.select(F.col("sample_id").alias("doc_id"), *[(F.abs(F.col("v")[i - 1]) * x).alias(n) for n, (i, x) in NUMBERS.items()])
    return loc.join(f, "doc_id", "left")


SAMPLES = f"""{LOC}, {bed.FEAT}, {ROLE_CTE}, samples AS (SELECT doc_id, path, split_part(path, '/', 2) AS origin, role, {", ".join(f"abs(v[{i}]) * {x} AS {n}" for n, (i, x) in NUMBERS.items())}
  FROM roles LEFT JOIN (SELECT sample_id AS doc_id, v FROM feat) USING (doc_id))"""


def _rule_sql(r: tags.Rule) -> str:
    tests = [f"role IN ({', '.join(repr(x) for x in r.roles)})"] if r.roles else []
    tests += [f"{c} {op} {x}" for c, op, x in r.features]
    some = [f"origin = '{o}'" for o in r.origins] + [f"contains(origin, '{o}')" for o in r.origin_matches] + [f"contains(lower(path), '{n}')" for n in r.name_matches]
    tests += ["(" + " OR ".join(some) + ")"] if some else []
    return f"SELECT doc_id, path, '{r.group}' AS tag_group, '{r.name}' AS tag FROM samples WHERE " + " AND ".join(tests)


def tag_rules(spark, d):
    return tags.apply_rules(_samples(spark, d), RULES).select("doc_id", "tag_group", "tag")


def rule_coverage(spark, d):
    return tags.rule_coverage(_samples(spark, d), RULES)


HITS = f"WITH {SAMPLES}, hits AS ({' UNION ALL '.join(map(_rule_sql, RULES))})"
RULE_NAMES = ", ".join(f"('{r.group}', '{r.name}')" for r in RULES)


def search_terms(spark, d):
    """Curated takes that name a loop or a drone, from one group of sources."""
    samples = _samples(spark, d)
    hit = tags.apply_rules(samples, RULES).groupBy("doc_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    index = samples.select("doc_id", "path", "role", "origin", paths.zone(_p()).alias("zone")).join(hit, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return tags.search(index, ("loop", "dark"), {"origin": ("src1",)}, any_=True, curated_only=True).select("doc_id", "role", "origin")


def evidence_gate(spark, d):
    s = _samples(spark, d).withColumn("issues", F.when(F.col("doc_id") % 9 == 0, "CLAP-SNARE")).withColumn("sample_type", names.sample_type(_p(), F.col("role")))
    return tags.kick_gate(s).select("doc_id", "gate", "confidence", "reasons", "gate_action")


def _gate_sql() -> str:
    shown = lambda n: f"'{n}=' || rtrim(rtrim(printf('%.2f', {n}), '0'), '.')"
    why = lambda *ns: "concat_ws(';', " + ", ".join(map(shown, ns)) + ")"
    missing = " OR ".join(f"{n} IS NULL" for n in ("duration_s", "sub_ratio", "low_ratio", "high_ratio", "centroid_hz", "tail_ms", "onset_density", "zcr", "crest"))
    loop = "(contains(lower(path), 'loop') OR contains(lower(path), 'groove') OR regexp_matches(path, '(?i)(^|[^0-9])[0-9]{2,3}\\s*bpm([^0-9]|$)') OR regexp_matches(path, '\\[[0-9]{2,3}\\]'))"
    bright = "(centroid_hz >= 3500.0 AND sub_ratio < 0.45)"
    act = lambda g: {"reject_as_kick": "keep-out-of-kicks", "likely_kick": "audition-as-kick"}.get(g, "")
    s = lambda g, c, r, a=None: f"{{'gate': '{g}', 'confidence': '{c}', 'reasons': {r}, 'gate_action': '{a or act(g)}'}}"
    rej = lambda r: s("reject_as_kick", "high", r)
    part = lambda test, r: f"CASE WHEN {test} THEN {r} END"
    return f"""WITH {SAMPLES}, g AS (SELECT doc_id, CASE WHEN role <> 'KICKS' THEN {s("review", "low", "'not-kicks-scope'", "not-kicks-scope")} WHEN doc_id % 9 = 0 THEN {rej("'role-conflict:CLAP-SNARE'")}
  WHEN {missing} THEN {s("review", "low", "'missing-acoustic-features'", "decode-or-manual-review")}
  WHEN {loop} OR duration_s >= 3.0 OR onset_density >= 4.0 THEN {rej("concat_ws(';', " + part(loop, "'sample_type:loop'") + ", " + part("duration_s >= 3.0", shown("duration_s")) + ", " + part("onset_density >= 4.0", shown("onset_density")) + ")")}
  WHEN mid_ratio >= 0.35 AND tail_ms <= 250 AND sub_ratio < 0.30 AND centroid_hz >= 1500 THEN {rej(why("tail_ms", "sub_ratio", "mid_ratio", "centroid_hz"))}
  WHEN high_ratio >= 0.45 OR {bright} OR zcr >= 0.18 THEN {rej("concat_ws(';', " + part("high_ratio >= 0.45", shown("high_ratio")) + ", " + part(bright, why("centroid_hz", "sub_ratio")) + ", " + part("zcr >= 0.18", shown("zcr")) + ")")}
  WHEN sub_ratio >= 0.55 AND low_ratio >= 0.55 AND high_ratio <= 0.25 AND duration_s <= 0.9 AND tail_ms <= 450 AND centroid_hz <= 2200 AND coalesce(flatness <= 0.45, true) AND onset_density <= 2 AND crest >= 2 AND zcr <= 0.12
    THEN {s("likely_kick", "high", why("sub_ratio", "crest", "centroid_hz"))} ELSE {s("review", "medium", "'mixed-evidence'", "ear-check-before-kick")} END AS r FROM samples)
SELECT doc_id, r.gate AS gate, r.confidence AS confidence, r.reasons AS reasons, r.gate_action AS gate_action FROM g"""


def label_violations(spark, d):
    i, pick = F.col("doc_id"), lambda test, a, b: F.when(test, a).otherwise(b)
    loc = bed.locations(spark, d)
    sheet = loc.select(
        i.alias("row"), pick(i % 11 == 0, F.substring("sample_id", 1, 12), F.col("sample_id")).alias("sample_id"), F.get(F.array(*map(F.lit, (*tags.DECISIONS, "maybe"))), (i % 4).cast("int")).alias("decision"),
        pick(i % 13 == 0, F.lit(""), ladders.instrument(_p())).alias("true_role"), pick(i % 7 == 0, F.lit(""), names.descriptor(_p())).alias("descriptor"), pick(i % 17 == 0, F.lit("bad tag"), F.lit("tone:dark; source:x")).alias("tags"),
    )
    return tags.label_violations(sheet, tuple(QUOTAS))


def audition_packet(spark, d):
    """Twice each role's quota from outside the curated zone, spread over sources."""
    loc = bed.locations(spark, d).filter(paths.zone(_p()) != "CURATED").select("doc_id", "sample_id", "path", F.get(paths.parts(_p()), F.lit(1)).alias("source"), ladders.instrument(_p()).alias("role"))
    quota = F.create_map(*[F.lit(x) for kv in QUOTAS.items() for x in kv])[F.col("role")]
    out = select.round_robin(loc.filter(F.col("role").isin(*QUOTAS)), ["sample_id", "path"], ["source"], ["source"], ["role"], 2 * max(QUOTAS.values()))
    return out.filter(F.col("place") <= 2 * quota).select("role", "place", "source", "doc_id")


QUOTA_ROWS = ", ".join(f"('{r}', {n})" for r, n in QUOTAS.items())


def quota_shortage(spark, d):
    """What each role lacks of its quota when good documents are the favourites."""
    loc = bed.locations(spark, d).select("doc_id", ladders.instrument(_p()).alias("role"))
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id")
    have = loc.join(good, "doc_id").groupBy("role").agg(F.count("*").alias("have"))
    quota = spark.createDataFrame(list(QUOTAS.items()), "role string, quota long")
    return F.broadcast(quota).join(have, "role", "left").select("role", (F.col("quota") - F.coalesce("have", F.lit(0))).alias("short")).filter("short > 0")


def crate_names(spark, d):
    loc = bed.locations(spark, d).select("doc_id", "path", "sample_id", ladders.instrument(_p()).alias("role"))
    loc = plans.numbered(loc.filter(F.col("role").isin(*names.ROLE_CODES)), ["role"], ["path"], "_i")
    return loc.select("doc_id", "role", names.compact_name(F.col("role"), F.col("_i"), paths.stem(_p()), F.col("sample_id")).alias("name"))


def run_report(spark, d):
    """Counts by role, confidence and zone in one pass of grouping sets."""
    loc = bed.locations(spark, d).select(ladders.role(_p()).alias("r"), paths.zone(_p()).alias("zone")).select("r.role", "r.confidence", "zone")
    return loc.groupingSets([["role"], ["confidence"], ["zone"], []], "role", "confidence", "zone").agg(F.count("*").alias("n"))


def cluster_kmeans(spark, d):
    f = bed.features(spark, d).select("role", F.lpad(F.col("sample_id").cast("string"), 10, "0").alias("path"), F.slice("v", 1, 13).alias("v"))
    return cluster.cluster(f, "v", 13).withColumn("distance", F.round("distance", 6))


def _kmeans_sql(dims: int, rounds: int) -> str:
    """Farthest-first centroids and Lloyd's rounds, each by recursion; a role's centroids are a list of lists."""
    each = lambda x: "[" + ", ".join(x.format(j=j) for j in range(1, dims + 1)) + "]"
    gaps = f"list_transform(cents, lambda c: sqrt(list_sum(list_transform(range(1, {dims + 1}), lambda j: (z[j] - c[j]) * (z[j] - c[j])))))"
    moved = f"list_max(list_transform(range(1, k + 1), lambda i: list_max(list_transform(range(1, {dims + 1}), lambda j: abs(new[i][j] - cents[i][j])))))"
    return f"""WITH RECURSIVE {bed.FEAT}, e AS (SELECT role, lpad(sample_id::VARCHAR, 10, '0') AS path, v FROM feat WHERE v[4] IS NOT NULL),
s AS (SELECT role, count(*) AS n, {each("avg(v[{j}])")} AS m, {each("stddev_pop(v[{j}])")} AS d FROM e GROUP BY role),
y AS (SELECT role, path, CASE WHEN n < 4 THEN 1 ELSE least(8, greatest(2, n // 30)) END AS k, {each("(v[{j}] - m[{j}]) / CASE WHEN d[{j}] = 0 THEN 1 ELSE d[{j}] END")} AS z FROM e JOIN s USING (role)),
f AS (SELECT role, k, 1 AS i, [first(z ORDER BY path)] AS cents, [min(path)] AS names FROM y GROUP BY role, k
  UNION ALL SELECT role, k, i + 1, list_append(first(cents), first(z ORDER BY gap DESC, path)), list_append(first(names), first(path ORDER BY gap DESC, path))
  FROM (SELECT role, f.k, i, cents, names, z, path, list_min({gaps}) AS gap FROM f JOIN y USING (role) WHERE i < f.k AND NOT list_contains(names, path)) GROUP BY role, k, i),
g AS (SELECT role, k, 1 AS t, cents FROM f WHERE i = k
  UNION ALL SELECT role, k, t + 1, new FROM (
    SELECT role, k, t, cents, list_transform(range(1, k + 1), lambda i: coalesce(list_filter(ms, lambda m: m.c = i)[1].v, cents[i])) AS new FROM (
      SELECT role, k, t, first(cents) AS cents, list({{'c': c, 'v': v}}) AS ms FROM (
        SELECT role, k, t, first(cents) AS cents, c, {each("avg(z[{j}])")} AS v FROM (
          SELECT role, k, t, cents, z, list_position(ds, list_min(ds)) AS c FROM (SELECT role, g.k, t, cents, z, {gaps} AS ds FROM g JOIN y USING (role) WHERE g.k > 1 AND t < {rounds}))
        GROUP BY role, k, t, c)
      GROUP BY role, k, t)) WHERE {moved} > 1e-12),
l AS (SELECT role, first(cents ORDER BY t DESC) AS cents FROM g GROUP BY role),
o AS (SELECT role, path, (list_position(ds, list_min(ds)) - 1)::INT AS cluster, list_min(ds) AS distance FROM (SELECT role, path, {gaps} AS ds FROM l JOIN y USING (role)))
SELECT role, path, cluster, round(distance, 6) AS distance, path = first(path) OVER (PARTITION BY role, cluster ORDER BY distance, path) AS representative FROM o"""


QUERIES = {f.__name__: f for f in (
    bucket_classify, proposed_names, origin_resolve, tag_rules, rule_coverage, search_terms, evidence_gate, label_violations, audition_packet, quota_shortage, crate_names, run_report, cluster_kmeans,
)}

ORACLE_SQL = {
    "bucket_classify": BUCKET_SQL,
    "proposed_names": _names_sql(),
    "origin_resolve": _origin_sql(),
    "tag_rules": f"{HITS} SELECT doc_id, tag_group, tag FROM hits",
    "rule_coverage": f"""{HITS}, r AS (SELECT * FROM (VALUES {RULE_NAMES}) t(tag_group, tag)), c AS (SELECT tag_group, tag, count(*) AS n, array_to_string(list(path ORDER BY path)[1:3], ';') AS examples FROM hits GROUP BY ALL)
SELECT tag_group, tag, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM samples) AS share, coalesce(examples, '') AS examples FROM r LEFT JOIN c USING (tag_group, tag)""",
    "search_terms": f"""{HITS}, t AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(tag))), ' ') AS tags FROM hits GROUP BY doc_id)
SELECT doc_id, role, origin FROM samples LEFT JOIN t USING (doc_id) WHERE {ZONE} = 'CURATED' AND contains(origin, 'src1') AND regexp_matches(lower(path) || ' ' || coalesce(tags, '') || ' ' || origin, 'loop|dark')""",
    "cluster_kmeans": _kmeans_sql(13, 25),
    "evidence_gate": _gate_sql(),
    "label_violations": f"""{INSTRUMENT_SQL.replace(" SELECT doc_id, coalesce(", ", i AS (SELECT doc_id, coalesce(", 1)}), s AS (SELECT doc_id AS row, CASE WHEN doc_id % 11 = 0 THEN sample_id[1:12] ELSE sample_id END AS sample_id, doc_id % 4 AS dec,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE suggested END AS true_role, doc_id % 7 = 0 AS bare, doc_id % 17 = 0 AS bad FROM loc JOIN i USING (doc_id))
SELECT row, 'invalid sample_id' AS violation FROM s WHERE sample_id IS NULL OR length(sample_id) <> 64 UNION ALL SELECT row, 'invalid decision' FROM s WHERE dec = 3
UNION ALL SELECT row, 'favourite without a role' FROM s WHERE dec = 2 AND true_role NOT IN (SELECT r FROM (VALUES {QUOTA_ROWS}) q(r, n)) UNION ALL SELECT row, 'favourite without a descriptor' FROM s WHERE dec = 2 AND bare UNION ALL SELECT row, 'invalid tag' FROM s WHERE bad""",
    "audition_packet": f"""{INSTRUMENT_SQL.replace(" SELECT doc_id, coalesce(", ", i AS (SELECT doc_id, coalesce(", 1)}), q AS (SELECT * FROM (VALUES {QUOTA_ROWS}) t(role, quota)),
s AS (SELECT doc_id, sample_id, path, split_part(path, '/', 2) AS source, suggested AS role, quota FROM loc JOIN i USING (doc_id) JOIN q ON role = suggested WHERE {ZONE} <> 'CURATED'),
t AS (SELECT *, row_number() OVER (PARTITION BY role, source ORDER BY sample_id, path) AS turn FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY turn, source) AS place FROM t) SELECT role, place, source, doc_id FROM p WHERE place <= 2 * quota""",
    "quota_shortage": f"""{INSTRUMENT_SQL.replace(" SELECT doc_id, coalesce(", ", i AS (SELECT doc_id, coalesce(", 1)}), q AS (SELECT * FROM (VALUES {QUOTA_ROWS}) t(role, quota)), h AS (SELECT suggested AS role, count(*) AS have FROM i JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)
SELECT role, quota - coalesce(have, 0) AS short FROM q LEFT JOIN h USING (role) WHERE quota > coalesce(have, 0)""",
    "crate_names": f"""{INSTRUMENT_SQL.replace(" SELECT doc_id, coalesce(", ", i AS (SELECT doc_id, coalesce(", 1)}), s AS (SELECT doc_id, sample_id, path, suggested AS role, row_number() OVER (PARTITION BY suggested ORDER BY path) AS n, {STEM} AS stem FROM loc JOIN i USING (doc_id) WHERE suggested <> '')
SELECT doc_id, role, CASE role {" ".join(f"WHEN '{r}' THEN '{c}'" for r, c in names.ROLE_CODES.items())} END || CASE WHEN n < 10 THEN '0' ELSE '' END || n || '_' || {_norm("stem")}[1:8] || '_' || sample_id[1:4] || '.wav' AS name FROM s""",
    "run_report": f"WITH {LOC}, {ROLE_CTE} SELECT role, confidence, zone, count(*) AS n FROM (SELECT role, confidence, {ZONE} AS zone FROM roles) GROUP BY GROUPING SETS ((role), (confidence), (zone), ())",
}
