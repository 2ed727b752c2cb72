"""Columns that propose names: tempo, key, description, pack and device names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratelake.functions import paths

# Formats and words that decide names.
BPM = r"(?i)(?<![0-9])[0-9]{2,3}\s*bpm(?![0-9])"
BRACKET_BPM = r"\[[0-9]{2,3}\]"
BARE_BPM = r"(?i)(?<![a-z0-9])(?:[6-9][0-9]|1[0-9][0-9]|200)(?![a-z0-9])"
KEY = r"(?i)(?<![a-z])([a-g](?:#|b)?)(?:\s*(maj|min|major|minor|m))?(?![a-z])"
IN_KEY = r"(?i)\bin\s+[a-g](?:#|b)?\s*(?:maj|min|major|minor|m)?\b"
NAMED_KEY = r"(?i)\b[a-g](?:#|b)?\s*(?:maj|min|major|minor|m)\b"
FORMAT_WORDS = ("bpm", "wav", "aif", "aiff", "flac", "mp3", "ogg")
ROLE_PREFIX = {
    "KICKS": "kick", "CLAP-SNARE": "clap-snare", "HATS-CYM": "hat-cym", "PERC": "perc", "BASS": "bass", "SYNTH-STAB-CHORD": "synth-stab",
    "DRONE-ATMOS": "drone-atmos", "FX-RISE-IMPACT": "fx", "VOCALS": "vocal",
}
NAME_PREFIXES = ("clap-snare-", "hat-cym-", "synth-stab-", "drone-atmos-", "kick-", "perc-", "bass-", "fx-", "vocal-", "review-")
ONE_SHOT_ROLES = ("KICKS", "CLAP-SNARE", "HATS-CYM", "PERC", "FX-RISE-IMPACT", "VOCALS")
PACK_NOISE = ("multiformat", "multi", "wav", "flac", "aiff", "aif", "scd", "mp3", "samples", "sample", "decibel", "pack")
EXPORT_ROLES = {
    "KICKS": "KICK", "CLAP-SNARE": "SNARE", "HATS-CYM": "HAT-CLOSED", "PERC": "PERC", "BASS": "BASS", "SYNTH-STAB-CHORD": "STAB-CHORD",
    "DRONE-ATMOS": "TEXTURE-DRONE", "FX-RISE-IMPACT": "FX", "VOCALS": "VOCAL", "DRUM-LOOPS": "DRUM-LOOP",
}
REFINEMENTS = {
    "CLAP-SNARE": (("CLAP", ("clap", "cp")), ("RIM", ("rim", "rimshot", "rs")), ("SNARE", ("snare", "sd"))),
    "HATS-CYM": (
        ("HAT-OPEN", ("open", "ohh", "oh-", "openhat")), ("HAT-CLOSED", ("closed", "chh", "clhat", "hhc")), ("RIDE", ("ride",)),
        ("CYMBAL", ("crash", "cymbal", "cym")), ("SHAKER", ("shaker", "tamb")),
    ),
    "PERC": (("TOM", ("tom", "timbale")),),
}
ROLE_WORDS = ("kick", "clap", "snare", "hat", "cym", "perc", "bass", "synth", "stab", "drone", "atmos", "fx", "vocal", "review", "bd", "sd", "hh", "loop")
ROLE_CODES = {
    "KICK": "BD", "SNARE": "SD", "CLAP": "CP", "RIM": "RS", "HAT-CLOSED": "CH", "HAT-OPEN": "OH", "SHAKER": "SH", "CYMBAL": "CY", "RIDE": "RD", "TOM": "TM",
    "PERC": "PC", "BASS": "BS", "STAB-CHORD": "ST", "FX": "FX", "VOCAL": "VX", "DRUM-LOOP": "DL", "BASS-LOOP": "BL", "SYNTH-LOOP": "SL", "VOCAL-LOOP": "VL", "TEXTURE-DRONE": "TX",
}
PROCESSING = {"Orig": "original", "Tape": "tape", "TapeSat": "tape-saturated", "X": "processed", "X2": "processed-more"}


def lookup(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def musical_key(stem: Column) -> Column:
    """The first key that is more than a bare letter; ``#`` as ``s``, minor keys with ``m``."""
    found = F.arrays_zip(F.regexp_extract_all(stem, F.lit(KEY), F.lit(1)).alias("note"), F.regexp_extract_all(stem, F.lit(KEY), F.lit(2)).alias("mode"))
    first = F.get(F.filter(found, lambda k: (F.length(k["note"]) > 1) | (k["mode"] != "")), F.lit(0))
    minor = F.when(F.lower(first["mode"]).isin("m", "min", "minor"), "m").otherwise("")
    return F.concat(F.lower(F.replace(first["note"], F.lit("#"), F.lit("s"))), minor)


def description(stem: Column) -> Column:
    s = stem
    for pattern in (BPM, BRACKET_BPM, BARE_BPM, IN_KEY, NAMED_KEY):
        s = F.regexp_replace(s, pattern, "")
    words = F.filter(F.split(F.lower(s), "[^a-z0-9#b]+"), lambda w: (w != "") & ~w.isin(*FORMAT_WORDS))
    return paths.normalise_token(F.array_join(words, "-"))


def drop_prefix(desc: Column, prefix: str) -> Column:
    """Of the prefix's words only the first that leads the description goes."""
    out = None
    for word in prefix.split("-"):
        for test, value in ((desc == word, F.lit("sample")), (desc.startswith(word + "-"), F.substr(desc, F.lit(len(word) + 2)))):
            out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(desc)


def source(path: Column) -> Column:
    return F.when(F.size(paths.parts(path)) > 1, paths.normalise_token(F.get(paths.parts(path), F.lit(1)))).otherwise("loose")


def proposed_name(path: Column, role: Column) -> Column:
    """Loops: tempo, key, description, source; others: role prefix, description, source."""
    stem, desc = paths.stem(path), description(paths.stem(path))
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    fields = [paths.bpm(path), F.nullif(musical_key(stem), F.lit("")), desc, source(path)]
    loop = (role == "DRUM-LOOPS") | paths.parts_text(path).contains("loop")
    short = F.lit(None).cast("string")
    for name, prefix in [*ROLE_PREFIX.items(), (None, "review")]:
        value = F.concat(F.lit(prefix + "-"), drop_prefix(desc, prefix), F.lit("_"), source(path))
        short = F.coalesce(short, value if name is None else F.when(role == name, value))
    return F.concat(F.when(loop, paths.normalise_token(F.concat_ws("_", *fields))).otherwise(paths.normalise_token(short)), ext)


def sample_type(path: Column, role: Column, duration: Column | None = None) -> Column:
    out = F.when(paths.loop_word(path) | paths.bpm(path).isNotNull(), "loop").when(role == "DRONE-ATMOS", "texture")
    if duration is not None:
        out = out.when(duration < 1.5, "one-shot")
    return out.when(role.isin(*ONE_SHOT_ROLES), "one-shot").otherwise("unknown")


def pack_slug(raw: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(raw), "[a-z]{2,4}-[0-9]{3,6}", " "), r"[.\s_-]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*PACK_NOISE) & ~w.rlike("^[0-9]{3,6}$")), "-")


def processing_tag(path: Column) -> Column:
    stem = paths.stem(path)
    tests = [F.when(F.right(stem, F.lit(len(s) + 1)).isin(*[c + s for c in "_- "]), F.lit(tag)) for s, tag in sorted(PROCESSING.items(), key=lambda kv: -len(kv[0]))]
    return F.coalesce(*tests, F.lit(""))


def export_role(role: Column, path: Column) -> Column:
    name = F.lower(F.element_at(paths.parts(path), -1))
    bare = F.coalesce(*[F.when(name.startswith(p), F.substr(name, F.lit(len(p) + 1))) for p in NAME_PREFIXES], name)
    any_of = lambda words: F.greatest(*[bare.contains(w) for w in words], F.lit(False))
    refined = [F.when((role == r) & any_of(words), F.lit(to)) for r, steps in REFINEMENTS.items() for to, words in steps]
    return F.coalesce(*refined, lookup(EXPORT_ROLES, role, "PERC"))


def descriptor(path: Column) -> Column:
    """The longest useful word of a name, the first among equals, in at most eight letters."""
    stem = paths.stem(path)
    own = F.when(stem == F.lower(stem), F.substring_index(stem, "_", 1)).otherwise(stem)
    words = F.filter(F.split(description(own), "-"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    long = F.filter(words, lambda w: F.length(w) >= 3)
    useful = F.filter(long, lambda w: ~w.isin(*ROLE_WORDS))
    longest = lambda ws: F.get(F.filter(ws, lambda w: F.length(w) == F.array_max(F.transform(ws, lambda x: F.length(x)))), F.lit(0))
    return F.substring(F.coalesce(longest(useful), longest(long), F.get(words, F.lit(0)), F.lit("sample")), 1, 8)


def family(path: Column) -> Column:
    """What takes of one sound share: the first three words of the name."""
    return F.array_join(F.slice(F.filter(F.split(F.substring_index(paths.stem(path), "_", 1), "-"), lambda w: w != ""), 1, 3), "-")


def compact_name(role: Column, index: Column, desc: Column, sample_id: Column, must: bool = False) -> Column:
    """``BD01_word_ab12.wav``; null where the role has no code, with ``must`` an error."""
    code = F.create_map(*[F.lit(x) for kv in ROLE_CODES.items() for x in kv])[role]
    if must:
        code = F.coalesce(code, F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("string"))
    return F.concat(code, F.when(index < 10, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string")), F.lit("_"), F.substring(paths.normalise_token(desc), 1, 8), F.lit("_"), F.substring(sample_id, 1, 4), F.lit(".wav"))


def bucket(path: Column) -> Column:
    """Loops, pads or one-shots by words of the path, raw substrings as they are; else other."""
    text = F.lower(path)
    any_of = lambda words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    return F.when(any_of(LOOP_KEYWORDS) | text.rlike(r"[0-9]{2,3}\s?bpm"), "LOOPS").when(any_of(PAD_KEYWORDS), "PADS-DRONES").when(any_of(ONE_SHOT_KEYWORDS), "ONE-SHOTS").otherwise("OTHER")


def bucket_path(path: Column, to: Column) -> Column:
    p = paths.parts(path)
    return F.when(F.size(p) >= 3, F.concat_ws("/", to, F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), "/"))).otherwise(F.concat_ws("/", to, F.lit("_loose"), F.element_at(p, -1)))


#: The buckets and the words of each.
BUCKETS = ("LOOPS", "ONE-SHOTS", "PADS-DRONES", "OTHER")
LOOP_KEYWORDS = ("loop", "lp", "groove", "bpm")
ONE_SHOT_KEYWORDS = ("oneshot", "one-shot", "one_shot", "one shot", "hit", "shot", "stab", "single")
PAD_KEYWORDS = ("pad", "drone", "atmos", "texture", "swell", "ambient")
