"""Columns that judge an asset: its source kind, bucket, tags, role conflicts, families, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratelake.functions import names, paths

# Folders, extensions, words and limits that decide results.
ROLE_FOLDERS = ("KICKS", "CLAP-SNARE", "HATS-CYM", "PERC", "DRUM-LOOPS", "BASS", "SYNTH-STAB-CHORD", "DRONE-ATMOS", "FX-RISE-IMPACT", "VOCALS", "_REVIEW")
STAGING = ("_EXPORT", "_TO-DELETE", "_QUARANTINE")
DEDUPE_EXCLUDE = (*STAGING, "PACKS")
AUDIO_EXTS = (".wav", ".aif", ".aiff", ".flac", ".mp3", ".ogg")
DOC_EXTS = (".pdf", ".txt", ".md", ".rtf", ".nfo", ".url")
DEVICE_EXTS = (".wav", ".aif", ".aiff")
DEVICE_SKIP = ("audio demo", "demo", "preview", "audition")
ONE_SHOT_CONFLICT_ROLES = ("KICKS", "CLAP-SNARE", "HATS-CYM", "PERC")
LONG_SECONDS, LONG_TAIL_MS = 3.0, 3000.0
BUCKET_ONE_SHOT = 1.5
SIGNALS = (
    ("KICKS", ("bassdrum", "bass drum", "bdrum", "kick", "kicks", "bd")),
    ("CLAP-SNARE", ("clap", "claps", "snare", "snares", "rim", "sd", "rs")),
    ("HATS-CYM", ("hihat", "hi hat", "hat", "hats", "hh", "cymbal", "cym", "ride", "crash", "shaker")),
    ("PERC", (
        "perc", "percussion", "conga", "bongo", "tom", "agogo", "tribal", "cabasa", "cabassa", "cow", "clave", "block", "tamb", "quijada", "timbale", "timb", "tabla", "triangle",
        "guiro", "maraca", "whistle", "finger", "fingers",
    )),
    ("DRUM-LOOPS", ("drum loop", "top loop", "beat loop", "loop", "loops", "groove", "grooves")),
    ("BASS", ("bass", "reese")),
    ("SYNTH-STAB-CHORD", ("synth", "stab", "chord", "pluck", "arp", "lead", "sh101", "acid", "guitar", "keys", "piano")),
    ("DRONE-ATMOS", ("drone", "drones", "pad", "pads", "atmos", "ambience", "ambient", "texture", "textures", "field")),
    ("FX-RISE-IMPACT", ("fx", "sfx", "impact", "riser", "rise", "uplifter", "downlifter", "sweep", "swell", "noise", "scratch", "door", "chime")),
    ("VOCALS", ("vocal", "vocals", "vox", "voice", "voices", "acapella", "accapella")),
)
FAMILY_STOP = ("wav", "aif", "aiff", "flac", "mp3", "ogg", "one", "shot", "oneshot", "loop", "loops", "samples", "sample")
TRUST, REVIEW = 0.80, 0.50


def two_places(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.00"))


def short_number(x: Column) -> Column:
    """Two places at most, without trailing zeros."""
    return F.call_function("format_number", x, F.lit("0.##"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def spaced(path: Column) -> Column:
    return F.translate(F.lower(path), "_-", "  ")


def has(text: Column, *words: str) -> Column:
    return F.greatest(*[text.contains(w) for w in words], F.lit(False))


def hidden(path: Column) -> Column:
    return F.exists(paths.parts(path), lambda p: p.startswith("._") | p.isin(".DS_Store", "__MACOSX"))


def staging(path: Column) -> Column:
    return F.get(paths.parts(path), F.lit(0)).isin(*STAGING)


def curated_role(path: Column) -> Column:
    """The role folder of a curated path; null elsewhere."""
    p = paths.parts(path)
    return F.when((F.get(p, F.lit(0)) == "CURATED") & F.get(p, F.lit(1)).isin(*ROLE_FOLDERS), F.get(p, F.lit(1)))


def source_name(path: Column) -> Column:
    p = paths.parts(path)
    first = F.get(p, F.lit(0))
    return F.when((F.size(p) > 1) & first.isin("PACKS", "_PACKS"), F.get(p, F.lit(1))).otherwise(first)


def source_kind(path: Column, set_root: Column, audio_root: Column) -> Column:
    """What a file of a library is; null for what isn't catalogued. The set columns are null outside a set."""
    ext, first = suffix(path), F.get(paths.parts(path), F.lit(0))
    audio = ext.isin(*AUDIO_EXTS)
    kind = (
        F.when(set_root.isNotNull() & ext.isin(".work", ".strd"), "octatrack-set-project")
        .when(audio_root.isNotNull() & path.startswith(F.concat(audio_root, F.lit("/"))) & audio, "octatrack-set-audio")
        .when(ext.isin(*DOC_EXTS), "document").when(~audio, None)
        .when(first == "CURATED", "curated-sample").when(first.isin("PACKS", "_PACKS"), "vendor-pack-audio")
        .when(~first.isin(*ROLE_FOLDERS, *DEDUPE_EXCLUDE, "CURATED", "MIDI"), "vendor-pack-audio")
    )
    return F.when(~hidden(path) & ~staging(path), kind)


def is_sample(kind: Column) -> Column:
    return kind.isin("curated-sample", "vendor-pack-audio", "octatrack-set-audio")


def bucket(path: Column, duration: Column | None = None) -> Column:
    """struct(bucket, reason): loop, pad and one-shot words, then the duration, if there is one."""
    by_word = names.bucket(path)
    result = lambda b, r: F.struct(b.alias("bucket"), r.alias("reason"))
    reasons = F.create_map(*map(F.lit, ("LOOPS", "keyword:loop", "PADS-DRONES", "keyword:pad", "ONE-SHOTS", "keyword:oneshot")))
    out = F.when(by_word != "OTHER", result(by_word, reasons[by_word]))
    if duration is not None:
        shown = F.concat(F.lit("duration:"), two_places(duration))
        out = out.when(duration < BUCKET_ONE_SHOT, result(F.lit("ONE-SHOTS"), F.concat(shown, F.lit(f"<{BUCKET_ONE_SHOT}"))))
        out = out.when(duration >= BUCKET_ONE_SHOT, result(F.lit("LOOPS"), F.concat(shown, F.lit(f">={BUCKET_ONE_SHOT}"))))
    return out.otherwise(result(F.lit("OTHER"), F.lit("unmatched")))


def signals(path: Column, roles: tuple[str, ...] | None = None) -> Column:
    """Array of struct(role, word): the roles' words that a path holds, in order; phrases anywhere, single words at the
    start of a token."""
    words = [(r, w) for r, ws in SIGNALS if roles is None or r in roles for w in ws]
    table = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(w).alias("word"), F.lit(" " in w).alias("phrase")) for r, w in words])
    text = F.translate(F.lower(path), "_-./", "    ")
    once = F.array(F.struct(text.alias("text"), F.split(text, "[^a-z0-9]+").alias("tokens")))  # bound once for all words
    held = lambda x: F.filter(table, lambda s: F.when(s["phrase"], F.contains(x["text"], s["word"])).otherwise(F.exists(x["tokens"], lambda t: F.startswith(t, s["word"]))))
    return F.transform(F.get(F.transform(once, held), F.lit(0)), lambda s: F.struct(s["role"].alias("role"), s["word"].alias("word")))


def role_conflict(path: Column, sample_type: Column, duration: Column, tail_ms: Column) -> Column:
    """struct(current_role, issues, reasons, action) of a curated asset whose path or measures speak for another
    role; null where nothing does."""
    role = curated_role(path)
    one_shot = role.isin(*ONE_SHOT_CONFLICT_ROLES)
    loop, long = one_shot & (sample_type == "loop"), one_shot & (duration > LONG_SECONDS)
    tail = one_shot & ~F.coalesce(duration > LONG_SECONDS, F.lit(False)) & (tail_ms > LONG_TAIL_MS)
    found = lambda test, issue, reason: F.when(test, F.struct(F.lit(issue).alias("issue"), reason.alias("reason")))
    named = F.transform(F.filter(signals(paths.content_path(path)), lambda s: s["role"] != role), lambda s: F.struct(s["role"].alias("issue"), F.concat(s["role"], F.lit(":"), s["word"]).alias("reason")))
    measured = F.array(
        found(loop, "DRUM-LOOPS", F.lit("sample_type:loop")), found(long, "long-audio", F.concat(F.lit("duration="), two_places(duration), F.lit("s"))),
        found(tail, "long-audio", F.concat(F.lit("tail_ms="), short_number(tail_ms))),
    )
    every = F.array(F.struct(role.alias("role"), F.concat(named, F.array_compact(measured)).alias("all")))
    text = lambda x, f: F.array_join(F.array_distinct(F.transform(x, lambda y: y[f])), ";")
    out = lambda x: F.when(F.size(x["all"]) > 0, F.struct(x["role"].alias("current_role"), text(x["all"], "issue").alias("issues"), text(x["all"], "reason").alias("reasons"), F.lit("review-or-quarantine").alias("action")))
    return F.when(role.isNotNull(), F.get(F.transform(every, out), F.lit(0)))


def character_tags() -> Column:
    """struct(tags, reasons) of rows (path, role, duration, bpm, processing_tag, processing_reason and measures).

    Of a tag's evidence the first in this order gives its reason: measures before words.
    """
    c, text = F.col, spaced(F.col("path"))
    num = lambda n: F.concat(F.lit(n + "="), short_number(c(n)))
    both = lambda *ns: F.concat_ws(";", *map(num, ns))
    seconds = F.concat(F.lit("duration="), two_places(c("duration")), F.lit("s"))
    words = lambda *ws: has(text, *ws)
    long_enough = c("duration") >= 1.0
    washed = (c("duration") >= 5.0) & (c("onset_density") <= 1.5) & (c("centroid_hz") <= 1200)
    wash = F.concat(F.lit("duration="), short_number(c("duration")), F.lit("s;"), both("onset_density", "centroid_hz"))
    rules = (
        ("KICKS", "subby", c("sub_ratio") >= 0.60, num("sub_ratio")),
        ("KICKS", "short", c("tail_ms") <= 250, num("tail_ms")),
        ("KICKS", "rumble-long", (c("tail_ms") >= 700) & (c("low_ratio") >= 0.55), both("tail_ms", "low_ratio")),
        ("KICKS", "clicky", c("attack_ms") <= 5, num("attack_ms")),
        ("KICKS", "subby", words("sub"), F.lit("path:sub")),
        ("KICKS", "short", c("duration") <= 0.75, seconds),
        ("KICKS", "rumble-long", words("rumble"), F.lit("path:rumble")),
        ("HATS-CYM", "metallic", (c("flatness") >= 0.35) & (c("centroid_hz") >= 3500), both("flatness", "centroid_hz")),
        ("HATS-CYM", "tight", c("tail_ms") <= 250, num("tail_ms")),
        ("HATS-CYM", "metallic", words("metallic", "metal"), F.lit("path:metallic")),
        ("HATS-CYM", "tight", words("tight", "closed") | F.coalesce(c("duration") <= 0.35, F.lit(False)), F.coalesce(seconds, F.lit("path:tight"))),
        ("PERC", "wood", words("wood", "clave", "block"), F.lit("path:wood-family")),
        ("PERC", "tribal", words("tribal", "conga", "tom", "cowbell"), F.lit("path:tribal-family")),
        ("DRUM-LOOPS", "sparse", long_enough & (c("onset_density") <= 2.0), num("onset_density")),
        ("DRUM-LOOPS", "busy", long_enough & (c("onset_density") >= 8.0), num("onset_density")),
        ("DRUM-LOOPS", "sparse", words("sparse"), F.lit("path:sparse")),
        ("DRUM-LOOPS", "busy", words("busy"), F.lit("path:busy")),
        ("DRONE-ATMOS", "dub-wash", washed, wash),
        ("DRONE-ATMOS", "dub-wash", words("dub", "wash"), F.lit("path:dub/wash")),
    )
    hit = lambda test, tag, reason: F.when(test, F.struct(tag.alias("tag"), reason.alias("reason")))
    found = [hit((c("role") == role) & test, F.lit(tag), reason) for role, tag, test, reason in rules]
    found.append(hit((c("role") == "DRUM-LOOPS") & words("top") & (c("bpm") != ""), F.concat(F.lit("top-"), c("bpm")), F.concat(F.lit("path:top;bpm="), c("bpm"))))
    found.append(hit(c("processing_tag") != "", c("processing_tag"), c("processing_reason")))
    every = F.array_compact(F.array(*found))
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["tag"]), x["tag"]) == i + 1)
    return F.struct(F.array_join(F.transform(first, lambda x: x["tag"]), ";").alias("tags"), F.array_join(F.transform(first, lambda x: x["reason"]), ";").alias("reasons"))


def processing_reason(path: Column) -> Column:
    stem = paths.stem(path)
    longest = sorted(names.PROCESSING, key=len, reverse=True)
    return F.coalesce(*[F.when(F.right(stem, F.lit(len(s) + 1)).isin(*[c + s for c in "_- "]), F.lit("filename_suffix:" + s)) for s in longest], F.lit(""))


def name_family(name: Column) -> Column:
    """A stem's words without the stop words; all of them if nothing else is left."""
    words = F.filter(F.split(F.lower(paths.stem(name)), "[^a-z0-9]+"), lambda w: w != "")
    useful = F.filter(words, lambda w: ~w.isin(*FAMILY_STOP))
    return F.array_join(F.when(F.size(useful) > 0, useful).otherwise(words), "-")


def digit_shape(name: Column) -> Column:
    """A stem with its runs of digits as ``#``; what follows the first ``_``, its source, leads."""
    stem = F.lower(paths.stem(name))
    main = F.substring_index(stem, "_", 1)
    source = F.translate(F.when(stem.contains("_"), F.substr(stem, F.locate("_", stem) + 1)).otherwise(""), "_", "-")
    shape = F.regexp_replace(main, "[0-9#]+", "#")
    shape = F.coalesce(F.nullif(F.btrim(shape, F.lit("-")), F.lit("")), main)
    return F.when(source != "", F.concat(source, F.lit("/"), shape)).otherwise(shape)


def crate_family(path: Column, kind: Column, source: Column) -> Column:
    """What crates spread over: folders of a curated role, of a set's audio or of a pack."""
    p, n = paths.parts(path), F.size(paths.parts(path))
    lead = lambda k: F.array_join(F.slice(p, F.lit(1), k), "/")
    audio = F.array_position(p, "AUDIO").cast("int")
    parent = F.coalesce(F.nullif(lead(F.greatest(n - 1, F.lit(0))), F.lit("")), F.lit("."))
    return (
        F.when((kind == "curated-sample") & (n >= 4), lead(F.lit(3)))
        .when((kind == "curated-sample") & (n == 3), F.concat_ws("/", lead(F.lit(2)), digit_shape(F.get(p, F.lit(2)))))
        .when((kind == "octatrack-set-audio") & (audio == 0), source).when(kind == "octatrack-set-audio", lead(F.least(n - 1, audio + 3)))
        .when(n >= 3, lead(F.lit(3))).otherwise(F.coalesce(F.nullif(source, F.lit("")), parent))
    )


def band(probability: Column) -> Column:
    return F.when(probability >= TRUST, "trust").when(probability >= REVIEW, "review").otherwise("low")


def acoustic_label(sub: Column, centroid: Column, flatness: Column, tail: Column, onset: Column, duration: Column) -> Column:
    """At most three traits of a group's means, ``balanced`` without any."""
    tone = F.when(sub >= 0.60, "subby").when(centroid >= 3500, "bright").when(centroid <= 500, "dark")
    noise = F.when(flatness >= 0.35, "noisy").when(flatness <= 0.05, "tonal")
    length = F.when(tail <= 250, "short").when(tail >= 1000, "long")
    density = F.when(duration >= 1.0, F.when(onset <= 2.0, "sparse").when(onset >= 8.0, "busy"))
    traits = F.slice(F.array_compact(F.array(tone, noise, length, density)), 1, 3)
    return F.when(F.size(traits) > 0, F.array_join(traits, "-")).otherwise("balanced")


def crate_reason(role: Column, sample_type: Column, tags: Column) -> Column:
    return F.concat_ws(";", *[F.nullif(c, F.lit("")) for c in (role, sample_type, tags)])


def dup_reason(score: Column) -> Column:
    return F.concat(F.lit("long-loop;stem-family;acoustic-score="), F.call_function("format_number", score, F.lit("0.000")))


# Predicates of rows (path, role, sample_type, duration, source_kind, conflict, gate).


def one_shot_candidate() -> Column:
    c = F.col
    return c("role").isin(*ONE_SHOT_CONFLICT_ROLES) & (c("sample_type") == "one-shot") & F.coalesce(c("duration") <= 3.0, F.lit(True))


def gate_passed() -> Column:
    """Kicks need a ``likely_kick``; other roles pass."""
    return (F.col("role") != "KICKS") | (F.coalesce(F.col("gate"), F.lit("")) == "likely_kick")


def audition_candidate() -> Column:
    folder = F.coalesce(curated_role(F.col("path")) == F.col("role"), F.lit(False))
    return ~has(spaced(F.col("path")), *DEVICE_SKIP) & ((F.col("source_kind") != "curated-sample") | folder) & F.col("conflict").isNull() & gate_passed()


def device_candidate() -> Column:
    """What a sampler can load of the audition candidates."""
    return audition_candidate() & suffix(F.col("path")).isin(*DEVICE_EXTS)


def device_one_shot() -> Column:
    return one_shot_candidate() & device_candidate()


def cluster_issue() -> Column:
    """A one-shot role whose path, length or tail speaks for a loop."""
    c = F.col
    long = F.coalesce(c("duration") > LONG_SECONDS, F.lit(False)) | F.coalesce(c("tail_ms") > LONG_TAIL_MS, F.lit(False))
    return c("role").isin(*ONE_SHOT_CONFLICT_ROLES) & ((F.size(signals(c("path"), ("DRUM-LOOPS",))) > 0) | long)


def cluster_candidate() -> Column:
    return ~has(spaced(F.col("path")), *DEVICE_SKIP) & F.col("conflict").isNull() & ~cluster_issue() & gate_passed()
