"""Origins, tag rules, search and the gates of curation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelake.functions import analysis, paths

# Folder names that tell nothing of an origin (compared as normalised tokens), and what tokens stand for.
GENERIC = (
    "samples", "sample", "audio", "wav", "wavs", "aiff", "loops", "one-shots", "oneshots",
    "hits", "sounds", "files", "loose", "misc", "new", "old", "sorted", "unsorted",
)
ZONES = (
    "packs", "catalogue", "curated", "presets", "midi", "_legacy", "_review",
    "_export", "_to-delete", "_quarantine", "00_inbox", "_packs", "drum-kits",
)
ALIASES = {
    "sa909_samples": "goldbaby-super-analog-909", "tapesh101_samples": "goldbaby-tape-sh101", "sp1200vol2_samples": "goldbaby-sp1200-vol2", "sp1200_samples": "goldbaby-sp1200",
    "sean": "sean-archive", "seanbackup": "sean-archive", "sean_backup": "sean-archive",
}
LEAST_TOKEN_COUNT = 3
DECISIONS = ("reject", "keep", "favourite")
TAG_GROUPS = ("envelope", "tone", "texture", "source", "device")


def structural(extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The names that tell nothing, as ``paths.normalise_token`` leaves them: lower case, without outer dashes."""
    return tuple(dict.fromkeys(n.lower().strip("-_") for n in (*GENERIC, *ZONES, *analysis.ROLE_FOLDERS, *extra)))


STRUCTURAL = structural()


def _canonical(token: Column, structural: tuple) -> Column:
    """The pack a token stands for; null where it stands for none."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[token]
    plain = F.when(~token.isin(*structural) & (token != ""), F.translate(paths.normalise_token(token), "_", "-"))
    return F.coalesce(alias, plain)


def resolve_origins(locations: DataFrame, structural: tuple = STRUCTURAL) -> DataFrame:
    """sample_id, origin, confidence, method, token: the best evidence over a sample's paths.

    A pack folder in the path is exact. Else the name's longest suffix after a ``_`` that is a
    frequent source token is parsed, and the name's own token guessed. Suffixes are exploded and
    met by equality. Of equal confidence the first path in order wins.
    """
    stem = paths.stem(F.col("path"))
    rows = locations.select("sample_id", "path", stem.alias("_stem"))
    vocab = rows.select(paths.source_token_raw(F.col("_stem")).alias("_token")).filter("_token IS NOT NULL").groupBy("_token").count().filter(F.col("count") >= LEAST_TOKEN_COUNT).select("_token")
    p = paths.parts(F.col("path"))
    inner = F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
    folder = F.get(F.filter(F.transform(inner, lambda x: F.struct(_canonical(paths.normalise_token(x), structural).alias("o"), x.alias("t"))), lambda s: s["o"].isNotNull()), F.lit(0))
    rows = rows.withColumn("_folder", folder)
    rest = rows.filter("_folder IS NULL AND _stem = lower(_stem)")
    words = F.split("_stem", "_")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: F.array_join(F.slice(words, i, F.size(words)), "_"))
    known = rest.withColumn("_token", F.explode(suffixes)).filter("_token <> ''").join(vocab, "_token")
    known = known.groupBy("path").agg(F.max_by("_token", F.length("_token")).alias("_known"))
    j = rows.join(known, "path", "left")
    bare = lambda t: F.regexp_replace(t, "-[0-9]+$", "")
    own = F.when((F.col("_stem") == F.lower("_stem")) & F.contains("_stem", F.lit("_")), F.substr("_stem", F.locate("_", F.col("_stem")) + 1)).otherwise("")
    found = lambda o, conf, method, t: F.when(o.isNotNull(), F.struct(o.alias("origin"), F.lit(conf).alias("confidence"), F.lit(method).alias("method"), t.alias("token")))
    none = F.struct(F.lit("unknown").alias("origin"), F.lit("none").alias("confidence"), F.when(F.col("_own") != "", "generic-token").otherwise("no-token-in-filename").alias("method"), F.lit("").alias("token"))
    j = j.withColumn("_own", own)
    best = F.coalesce(
        found(F.col("_folder.o"), "exact", "path-folder", F.col("_folder.t")),
        found(_canonical(bare(F.col("_known")), structural), "parsed", "filename-token", F.col("_known")),
        found(_canonical(bare(F.col("_own")), structural), "guessed", "filename-token-fallback", F.col("_own")),
        none,
    )
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"exact": 0, "parsed": 1, "guessed": 2, "none": 3}.items() for x in kv]), F.col("_best.confidence"))
    return j.withColumn("_best", best).groupBy("sample_id").agg(F.min_by("_best", F.struct(rank, "path")).alias("_best")).select("sample_id", "_best.*")


@dataclass(frozen=True)
class Rule:
    """Roles and feature tests must all hold; of origins, origin parts and path parts, one must."""

    name: str
    group: str
    origins: tuple[str, ...] = ()
    origin_matches: tuple[str, ...] = ()
    name_matches: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    features: tuple[tuple[str, str, float], ...] = ()

    def column(self) -> Column:
        tests = [F.col("role").isin(*self.roles)] if self.roles else []
        ops = {">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__", "==": "__eq__"}
        tests += [getattr(F.col(c), ops[op])(x) for c, op, x in self.features]
        some = [F.col("origin") == o for o in self.origins] + [F.col("origin").contains(o) for o in self.origin_matches] + [F.lower("path").contains(n) for n in self.name_matches]
        if some:
            any_ = some[0]
            for s in some[1:]:
                any_ |= s
            tests.append(any_)
        elif not self.features:
            return F.lit(False)
        out = tests[0]
        for t in tests[1:]:
            out &= t
        return F.coalesce(out, F.lit(False))


def apply_rules(samples: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each (sample, rule) that fires: the input's columns, tag_group and tag."""
    hits = F.array_compact(F.array(*[F.when(r.column(), F.struct(F.lit(r.group).alias("tag_group"), F.lit(r.name).alias("tag"))) for r in rules]))
    return samples.withColumn("_hit", F.explode(hits)).select(*samples.columns, "_hit.*")


def rule_coverage(samples: DataFrame, rules: list[Rule], examples: int = 3) -> DataFrame:
    """tag_group, tag, n, share of all samples and the first paths of each rule; rules that never fire have 0."""
    hits = apply_rules(samples, rules)
    n = hits.groupBy("tag_group", "tag").agg(F.count("*").alias("n"))
    first = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("tag_group", "tag").orderBy("path"))).filter(F.col("_rn") <= examples)
    first = first.groupBy("tag_group", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "path"))), lambda s: s["path"]), ";").alias("examples"))
    names = samples.sparkSession.createDataFrame([(r.group, r.name) for r in rules], "tag_group string, tag string")
    total = samples.agg(F.count("*").alias("_total"))
    out = F.broadcast(names).join(n.join(first, ["tag_group", "tag"]), ["tag_group", "tag"], "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("tag_group", "tag", n.alias("n"), F.coalesce(F.try_divide(n, F.col("_total")), F.lit(0.0)).alias("share"), F.coalesce("examples", F.lit("")).alias("examples"))


def search(index: DataFrame, terms: tuple[str, ...] = (), groups: dict[str, tuple[str, ...]] | None = None, any_: bool = False, curated_only: bool = False) -> DataFrame:
    """Rows of the index (path, zone, role, origin, tags) that have all the terms, or any, in path,
    tags or origin, or as their role or a part of the path with ``_`` read as ``-``, and one value of each group. Groups but role and origin match any tag."""
    text = F.concat_ws(" ", F.lower("path"), F.array_join("tags", " "), "origin")
    parts = F.split(F.translate(F.lower("path"), "_", "-"), "/")
    hits = [text.contains(t) | (F.lower("role") == t) | F.array_contains(parts, t) for t in terms]
    out = index.filter(F.col("zone") == "CURATED") if curated_only else index
    if hits:
        out = out.filter(F.greatest(*hits, F.lit(False)) if any_ else F.least(*hits, F.lit(True)))
    for group, values in (groups or {}).items():
        if group == "role":
            out = out.filter(F.col("role").isin(*[v.upper() for v in values]))
        elif group == "origin":
            out = out.filter(F.greatest(*[F.col("origin").contains(v) for v in values], F.lit(False)))
        else:
            out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, values))))
    return out


def label_violations(labels: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """A row for each fault of a label sheet (row, sample_id, decision, true_role, descriptor, tags)."""
    bad = lambda test, message: F.when(F.coalesce(test, F.lit(True)), F.lit(message))
    favourite = F.coalesce(F.col("decision") == "favourite", F.lit(False))
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    grammar = F.exists(tags, lambda t: ~t.rlike("^(" + "|".join(TAG_GROUPS) + "):."))
    faults = F.array_compact(F.array(
        bad(~F.col("sample_id").rlike("^[0-9a-f]{64}$"), "invalid sample_id"),
        bad(~F.col("decision").isin(*DECISIONS), "invalid decision"),
        F.when(favourite, bad(~F.col("true_role").isin(*roles), "favourite without a role")),
        F.when(favourite, bad(F.col("descriptor") == "", "favourite without a descriptor")),
        bad(grammar, "invalid tag"),
    ))
    return labels.select("row", F.explode(faults).alias("violation"))


def shown(value: Column) -> Column:
    """Two places at most, without trailing zeros."""
    return F.call_function("format_number", value, F.lit("0.##"))


def kick_gate(df: DataFrame) -> DataFrame:
    """Evidence ladder over feature columns: gate, confidence, reasons and gate_action; the first step that applies
    decides. ``issues`` holds role conflicts of the name, null for none; duration_s falls back to duration and
    audio_error is read where there are such columns. The limits are fixed values."""
    rows, seconds = df, F.coalesce("duration_s", "duration") if "duration" in df.columns else F.col("duration_s")
    df = df.withColumns({"_kept_seconds": F.col("duration_s"), "duration_s": seconds})
    c = F.col
    why = lambda *names: F.concat_ws(";", *[F.concat(F.lit(n + "="), shown(c(n))) for n in names])
    if_ = lambda test, reason: F.when(test, reason)
    required = ["duration_s", "sub_ratio", "low_ratio", "high_ratio", "centroid_hz", "tail_ms", "onset_density", "zcr", "crest"]
    missing = F.greatest(*[c(n).isNull() for n in required])
    loop = c("sample_type") == "loop"
    dense = loop | (c("duration_s") >= 3.0) | (c("onset_density") >= 4.0)
    click = (c("mid_ratio") >= 0.35) & (c("tail_ms") <= 250.0) & (c("sub_ratio") < 0.30) & (c("centroid_hz") >= 1500.0)
    bright = (c("centroid_hz") >= 3500.0) & (c("sub_ratio") < 0.45)
    noisy = (c("high_ratio") >= 0.45) | bright | (c("zcr") >= 0.18)
    likely = (c("sub_ratio") >= 0.55) & (c("low_ratio") >= 0.55) & (c("high_ratio") <= 0.25) & (c("duration_s") <= 0.90) & (c("tail_ms") <= 450.0) & (c("centroid_hz") <= 2200.0)
    likely &= (c("flatness").isNull() | (c("flatness") <= 0.45)) & (c("onset_density") <= 2.0) & (c("crest") >= 2.0) & (c("zcr") <= 0.12)
    actions = {"reject_as_kick": "keep-out-of-kicks", "likely_kick": "audition-as-kick"}
    step = lambda g, conf, reasons, action=None: F.struct(F.lit(g).alias("gate"), F.lit(conf).alias("confidence"), reasons.alias("reasons"), F.lit(action or actions[g]).alias("gate_action"))
    failed = F.coalesce("audio_error", F.lit("")) != "" if "audio_error" in df.columns else F.lit(False)
    ladder = (
        F.when(c("role") != "KICKS", step("review", "low", F.lit("not-kicks-scope"), "not-kicks-scope"))
        .when(c("issues").isNotNull(), step("reject_as_kick", "high", F.concat(F.lit("role-conflict:"), c("issues"))))
        .when(failed | missing, step("review", "low", F.when(failed, "decode-error").otherwise("missing-acoustic-features"), "decode-or-manual-review"))
        .when(dense, step("reject_as_kick", "high", F.concat_ws(";", if_(loop, F.lit("sample_type:loop")), if_(c("duration_s") >= 3.0, why("duration_s")), if_(c("onset_density") >= 4.0, why("onset_density")))))
        .when(click, step("reject_as_kick", "high", why("tail_ms", "sub_ratio", "mid_ratio", "centroid_hz")))
        .when(noisy, step("reject_as_kick", "high", F.concat_ws(";", if_(c("high_ratio") >= 0.45, why("high_ratio")), if_(bright, why("centroid_hz", "sub_ratio")), if_(c("zcr") >= 0.18, why("zcr")))))
        .when(likely, step("likely_kick", "high", why("sub_ratio", "crest", "centroid_hz")))
        .otherwise(step("review", "medium", F.lit("mixed-evidence"), "ear-check-before-kick"))
    )
    out = df.withColumn("_gate", ladder).withColumn("duration_s", F.col("_kept_seconds"))
    return out.select(*rows.columns, "_gate.*")
