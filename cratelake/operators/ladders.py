"""First-match classifiers over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratelake.functions import paths

#: The words of each role, in the order in which they are tried.
LOOP_PHRASES = ("drum loop", "drum loops", "top loop", "top loops", "beat loop", "beats")
ROLE_WORDS = (
    ("KICKS", ("bassdrum", "bass drum", "bdrum", "kick", "kicks", "bd ", " bd", "sa909 bd")),
    ("CLAP-SNARE", ("clap", "claps", "snare", "snares", "rim", "sd ", " sd", "sa909 sd")),
    ("HATS-CYM", ("hihat", "hi hat", "hi-hat", "closedhh", "openhh", "hat", "hats", "cymbal", "cym", "ride", "crash", "shaker")),
    ("PERC", ("perc", "percussion", "conga", "bongo", "tom", "agogo", "tribal", "cabasa", "cabassa")),
    ("BASS", ("bass", "sub", "reese", "303")),
    ("SYNTH-STAB-CHORD", ("synth", "stab", "chord", "pluck", "arp", "lead", "sh101", "acid", "guitar", "keys", "piano")),
    ("DRONE-ATMOS", ("drone", "drones", "pad", "pads", "atmos", "ambience", "ambient", "texture", "textures", "field")),
    ("FX-RISE-IMPACT", ("fx", "sfx", "impact", "riser", "rise", "uplifter", "downlifter", "sweep", "swell", "noise")),
    ("VOCALS", ("vocal", "vocals", "vox", "voice", "voices", "acapella", "accapella")),
)
CODES = (("HATS-CYM", ("hh", "hho", "hhc", "ohh", "chh")), ("CLAP-SNARE", ("rs",)))
STEMS = (("PERC", ("cow", "clave", "cabasa", "conga", "block", "tamb", "agogo", "quijada", "timbale", "timb", "tabla", "triangle", "guiro", "maraca", "whistle")),)
INSTRUMENTS = (
    ("HAT-OPEN", ("open hat", "openh", "ohh")), ("HAT-CLOSED", ("closed hat", "closedh", "chh")), ("DRUM-LOOP", ("drum loop", "top loop", "beat loop")),
    ("BASS-LOOP", ("bass loop", "bassloop")), ("SYNTH-LOOP", ("synth loop", "chord loop")), ("VOCAL-LOOP", ("vocal loop", "vox loop")),
    ("TEXTURE-DRONE", ("texture", "drone", "atmos", "ambient")), ("KICK", ("kick", "bassdrum", "bass drum", " bd ")), ("SNARE", ("snare", " sd ")), ("CLAP", ("clap",)),
    ("RIM", ("rim",)), ("SHAKER", ("shaker",)), ("RIDE", ("ride",)), ("CYMBAL", ("cymbal", " cym ", "crash")), ("TOM", ("tom",)),
    ("PERC", ("perc", "conga", "bongo", "cowbell", "clave")), ("BASS", ("bass", "sub", "reese")), ("STAB-CHORD", ("stab", "chord", "synth", "pluck")),
    ("FX", (" fx ", "impact", "riser", "noise")), ("VOCAL", ("vocal", "vox", "voice")),
)
ONE_SHOT = 1.5  # seconds


def first_word(text: Column, needles: tuple) -> Column:
    return F.coalesce(*[F.when(text.contains(n), F.lit(n)) for n in needles])


def _result(role: str, confidence: str, reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), reason.alias("reason")))


def role(path: Column, duration: Column | None = None) -> Column:
    """struct(role, confidence, reason): loop phrases, role words, whole-token codes, token stems,
    loop words or a tempo, the duration; the first that applies decides."""
    text, toks = paths.parts_text(path), F.sort_array(paths.tokens(path))
    hit = lambda words: F.concat(F.lit("path:"), first_word(text, words))
    steps = [_result("DRUM-LOOPS", "high", hit(LOOP_PHRASES)), *[_result(r, "high", hit(ws)) for r, ws in ROLE_WORDS]]
    steps += [_result(r, "high", F.concat(F.lit("token:"), F.array_min(F.array_intersect(toks, F.array(*map(F.lit, cs)))))) for r, cs in CODES]
    for r, stems in STEMS:
        of = lambda t: F.coalesce(*[F.when(t.startswith(s), F.lit(s)) for s in stems])  # noqa: B023, E731
        steps.append(_result(r, "high", F.concat(F.lit("token:"), F.get(F.filter(F.transform(toks, of), lambda s: s.isNotNull()), F.lit(0)))))
    loop = paths.loop_word(path) | path.rlike(r"(?i)(?<![0-9])[0-9]{2,3}\s*bpm(?![0-9])")
    steps.append(_result("DRUM-LOOPS", "medium", F.when(loop, "path:loop")))
    if duration is not None:
        shown = F.call_function("format_number", duration, F.lit("0.00"))
        steps.append(_result("_REVIEW", "low", F.when(duration < ONE_SHOT, F.concat(F.lit("duration:"), shown, F.lit("<oneshot")))))
        steps.append(_result("DRUM-LOOPS", "medium", F.when(duration >= ONE_SHOT, F.concat(F.lit("duration:"), shown, F.lit(">=oneshot")))))
    return F.coalesce(*steps, _result("_REVIEW", "low", F.lit("unmatched")))


def instrument(path: Column) -> Column:
    padded = F.concat(F.lit(" "), F.translate(F.replace(F.lower(path), F.lit("/"), F.lit(" ")), "_-", "  "), F.lit(" "))
    return F.coalesce(*[F.when(first_word(padded, ws).isNotNull(), F.lit(r)) for r, ws in INSTRUMENTS], F.lit(""))
