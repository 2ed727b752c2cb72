"""Plans, registries, audits, signals and curation on small tables."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelake.functions import analysis
from cratelake.operators import audit, benchmark, catalog, curation, find, neardupe, plans, report, select, sets, signals, tags
from cratelake.operators.tags import Rule
from cratelake.sources import files as io


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def paths_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_unique_names_pass_over_taken_and_claimed_ones(spark):
    plan = spark.createDataFrame([("s1", "a/k.wav"), ("s2", "a/k.wav"), ("s3", "a/k.wav"), ("s4", "a/k.wav"), ("s5", "b/x"), ("s6", "a/k-3.wav")], "src string, dest string")
    got = dict(rows(plans.unique_names(plan, "dest", "src", paths_of(spark, "a/k.wav", "a/k-2.wav", "b/y"))))
    assert len(set(got.values())) == 6 and not set(got.values()) & {"a/k.wav", "a/k-2.wav"}
    assert got["s5"] == "b/x" and got["s6"] == "a/k-3.wav" and {got[f"s{i}"] for i in (1, 2, 3, 4)} <= {f"a/k-{n}.wav" for n in range(4, 9)}
    many = spark.createDataFrame([(f"s{i:04}", "k.wav") for i in range(300)], "src string, dest string")
    got = dict(rows(plans.unique_names(many, "dest", "src", paths_of(spark))))
    assert got == {f"s{i:04}": "k.wav" if i == 0 else f"k-{i + 1}.wav" for i in range(300)}
    folders = spark.createDataFrame([("a", "PACKS/v1.2"), ("b", "PACKS/v1.2")], "src string, dest string")
    assert rows(plans.unique_names(folders, "dest", "src", paths_of(spark, "PACKS/v1.2"), whole=True)) == [("a", "PACKS/v1.2-2"), ("b", "PACKS/v1.2-3")]


def test_review_asks_for_the_duration_only_where_the_path_is_silent(spark):
    files = spark.createDataFrame([("Pack/au2_132 drum loop.wav", 9.0), ("Pack/thing.wav", 2.0), ("Pack/other.wav", 0.5), ("Pack/kick.wav", 9.0), ("KICKS/kick.wav", 1.0), ("Pack/._kick.wav", 1.0), ("Pack/kick.txt", 1.0), ("loose.wav", 1.0)], "path string, seconds double")
    got = {r["source"]: r for r in plans.review(files, "seconds").collect()}
    assert set(got) == {"Pack/au2_132 drum loop.wav", "Pack/thing.wav", "Pack/other.wav", "Pack/kick.wav"}
    loop = got["Pack/au2_132 drum loop.wav"]
    assert (loop["role"], loop["bpm"], loop["tempo_fit"]) == ("DRUM-LOOPS", "132", "techno-core")
    assert (got["Pack/thing.wav"]["role"], got["Pack/other.wav"]["role"], got["Pack/other.wav"]["sample_type"]) == ("DRUM-LOOPS", "_REVIEW", "one-shot")
    assert got["Pack/kick.wav"]["proposed_path"] == "KICKS/kick.wav/kick-sample_kick.wav.wav"


def test_buckets_by_words_and_durations(spark):
    files = spark.createDataFrame([("P/s/a pad.wav", None), ("P/s/b.wav", 0.5), ("P/s/c.wav", 1.5), ("P/s/d.wav", None), ("P/Techno Loops/e.wav", 0.1)], "path string, seconds double")
    got = {r["src"]: (r["dest"], r["tag"]) for r in plans.bucket_plan(files, "seconds").collect()}
    assert got["P/s/a pad.wav"] == ("PADS-DRONES/s/a pad.wav", "PADS-DRONES|keyword:pad") and got["P/s/b.wav"][1] == "ONE-SHOTS|duration:0.50<1.5"
    assert got["P/s/c.wav"][1] == "LOOPS|duration:1.50>=1.5" and got["P/s/d.wav"][1] == "OTHER|unmatched" and got["P/Techno Loops/e.wav"][1] == "LOOPS|keyword:loop"


def test_intake_takes_folders_with_audio(spark):
    files = paths_of(spark, "Label ABC-123 Kicks WAV/a.wav", "Label Kicks/b.wav", "docs/x.txt", "PACKS/label-kicks/c.wav", "CURATED/KICKS/k.wav", "_EXPORT/e.wav", ".git/f.wav", "top.wav")
    plan = plans.intake_plan(files)
    got = rows(plan, "src", "dest")
    assert got == [("Label ABC-123 Kicks WAV", "PACKS/label-kicks-2"), ("Label Kicks", "PACKS/label-kicks-3")]
    log = rows(plans.manifest(plan, F.lit(datetime.date(2026, 1, 2))), "slug", "original")
    assert log == [("label-kicks-2", "Label ABC-123 Kicks WAV"), ("label-kicks-3", "Label Kicks")]


def test_preview_and_undo(spark):
    plan = spark.createDataFrame([("a", "x", "t"), ("b", "c", "t"), ("z", "y", "t")], "src string, dest string, tag string")
    out = plans.preview(plan, paths_of(spark, "a", "b", "c"))
    assert rows(out, "src", "status") == [("a", "moved"), ("b", "exists"), ("z", "missing")] and rows(plans.undo(out)) == [("x", "a")]
    with pytest.raises(Exception, match="migration incomplete"):
        plans.require_complete(out).collect()
    sized = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9)], "path string, size long")
    assert rows(plans.reclaimable(plan, sized)) == [(12, 2)]


def test_patterns_name_files_folders_and_globs(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# first\n\nA/*.wav\nB => ignored\nC/one.wav => My Name\nnothing/here\nD/**/x?.aif\n")
    files = paths_of(spark, "A/k.wav", "A/sub/n.wav", "B/k.wav", "B/s/t.flac", "C/one.wav", "D/x1.aif", "D/a/b/x2.aif", "D/a/xx3.aif", "B/readme.txt")
    plan, missing = plans.export_plan(plans.read_patterns(io.read_lines(spark, str(tmp_path / "m.txt"))), files)
    got = {r["src"]: (r["line"], r["out_name"]) for r in plan.collect()}
    assert got == {"A/k.wav": (3, "k.wav"), "B/k.wav": (4, "k_2.wav"), "B/s/t.flac": (4, "t.wav"), "C/one.wav": (5, "my-name.wav"), "D/x1.aif": (7, "x1.wav"), "D/a/b/x2.aif": (7, "x2.wav")}
    assert rows(missing, "pattern") == [("nothing/here",)]


def test_crates_are_checked_against_a_device(spark):
    sid = "a" * 64
    crate = spark.createDataFrame([(1, sid, "CURATED/KICK/a.wav", "KICK", "punchy", ""), (2, sid, "CURATED/KICK/a.wav", "KICK", "punchy", "stereo-essential"), (3, sid, "PACKS/b.wav", "DRUM-LOOP", "loop", ""), (4, sid, "gone.wav", "NOPE", "x", ""), (5, "b" * 64, "CURATED/KICK/a.wav", "SNARE", "y", "")], "row long, sample_id string, source_path string, role string, descriptor string, reason string")
    loc = spark.createDataFrame([("CURATED/KICK/a.wav", sid, 400.0), ("PACKS/b.wav", sid, 1.0)], "path string, sample_id string, duration double")
    plan, faults = plans.crate_plan(crate, "My Crate", loc, plans.devices(spark), "tr8s")
    got = {r["row"]: (r["out_path"], r["keep_stereo"]) for r in plan.collect()}
    assert got[1] == ("ROLAND/TR-8S/SAMPLE/my-crate/BD01_punchy_aaaa.wav", False) and got[2] == ("ROLAND/TR-8S/SAMPLE/my-crate/BD02_punchy_aaaa.wav", True)
    assert rows(faults.fillna(-1)) == [(-1, "too long"), (3, "one-shot roles only"), (3, "source outside CURATED"), (4, "missing source"), (4, "unknown role"), (5, "hash changed")]
    big = spark.range(1, 129).select(F.col("id").alias("row"), F.lit(sid).alias("sample_id"), F.lit("CURATED/KICK/a.wav").alias("source_path"), F.lit("KICK").alias("role"), F.lit("d").alias("descriptor"), F.lit("").alias("reason"))
    plan, faults = plans.crate_plan(big, "c", loc, plans.devices(spark), "digitakt")
    assert rows(faults, "violation") == [("too many rows",)] and plan.filter("out_path = 'c/KICK/BD128_d_aaaa.wav'").count() == 1
    assert rows(plans.crate_totals(crate, loc.withColumnRenamed("path", "source_path"))) == [(5, 1201.0)]
    bound = plans.bind_devices(spark.createDataFrame([("tr8s", "drums", None), ("digitakt", "drums", False), ("other", "x", True)], "device string, role string, enabled boolean"), plans.devices(spark))
    assert rows(bound, "device") == [("tr8s",)]


def test_references_fall_back_to_the_relative_path(spark):
    refs = spark.createDataFrame([("/p/set/a.als", "/lib/k.wav", None), ("/p/set/a.als", "/gone/k.wav", "../k2.wav"), ("/p/set/a.als", "/gone/x.wav", "x.wav"), ("/p/set/a.als", "", "sub/./y.wav")], "set_path string, raw_path string, relative_path string")
    got = plans.references(refs, paths_of(spark, "/lib/k.wav", "/p/k2.wav", "/p/set/sub/y.wav")).collect()
    assert sorted((r["resolved"], r["present"]) for r in got) == [("/gone/x.wav", False), ("/lib/k.wav", True), ("/p/k2.wav", True), ("/p/set/sub/y.wav", True)]


def test_migrations_are_blocked(spark):
    loc = spark.createDataFrame([("CURATED/KICKS/a.wav", "1"), ("CURATED/KICKS/b.wav", "2"), ("SEAN/c.wav", "3"), ("PACKS/d.wav", "4")], "path string, sample_id string")
    moves = spark.createDataFrame([("CURATED/KICKS", "CATALOGUE/KICKS", "legacy"), ("SEAN", "CATALOGUE/_LEGACY/SEAN", "personal")], "prefix string, to string, tag string")
    now = spark.createDataFrame([("CURATED/KICKS/a.wav", "1"), ("CURATED/KICKS/b.wav", "9"), ("SEAN/c.wav", "3"), ("CATALOGUE/KICKS/a.wav", "5")], "path string, sample_id string")
    projects = spark.createDataFrame([("s/one.als", "..CURATED/x"), ("s/Backup/two.als", "CURATED"), ("s/three.als", "none")], "path string, content string")
    plan, faults = plans.migration(loc, moves, plans.zone_references(projects), now)
    assert rows(plan, "src", "dest") == [("CURATED/KICKS/a.wav", "CATALOGUE/KICKS/a.wav"), ("CURATED/KICKS/b.wav", "CATALOGUE/KICKS/b.wav"), ("SEAN/c.wav", "CATALOGUE/_LEGACY/SEAN/c.wav")]
    assert rows(faults) == [("CATALOGUE/KICKS/a.wav", "destination exists"), ("CURATED/KICKS/b.wav", "hash changed since the scan"), ("s/one.als", "a project names the zone")]


SET_FILES = ("Live/proj/project.work", "Live/proj/bank01.work", "Live/proj/pattern.strd", "Live/AUDIO/k_TapeSat.wav", "Live/AUDIO/._k.wav", "Live/Install Guide.pdf", "Own/project.work", "Own/AUDIO/x.wav", "CURATED/KICKS/k.wav", "Vendor/kick.wav", "_EXPORT/e.wav", "MIDI/m.wav", "KICKS/old.wav")


def test_sets_and_sources(spark):
    files = paths_of(spark, *SET_FILES)
    found = sets.registry(files)
    assert rows(found, "set_root", "set_name", "audio_root", "projects", "patterns", "audio") == [("Live", "proj", "Live/AUDIO", 2, 1, 1), ("Own", "Own", "Own/AUDIO", 1, 0, 1)]
    assert {r["set_root"]: r["doc"] for r in found.collect()} == {"Live": "Live/Install Guide.pdf", "Own": "Live/Install Guide.pdf"}
    got = {r["path"]: tuple(r)[1:] for r in sets.sources(files).collect()}
    assert got["Live/AUDIO/k_TapeSat.wav"] == ("octatrack-set-audio", "Live", "tape-saturated", "filename_suffix:TapeSat") and got["Live/proj/pattern.strd"][0] == "octatrack-set-project"
    assert got["CURATED/KICKS/k.wav"][:2] == ("curated-sample", "CURATED") and got["Vendor/kick.wav"][0] == "vendor-pack-audio" and got["Live/Install Guide.pdf"][0] == "document"
    assert not {"_EXPORT/e.wav", "MIDI/m.wav", "KICKS/old.wav", "Live/AUDIO/._k.wav"} & set(got)


def loops(spark, *items):
    names = [n for n, _, _ in neardupe.TERMS]
    base = dict.fromkeys(names, 0.5) | {"duration_s": 32.126, "tail_ms": 900.0, "centroid_hz": 800.0}
    return spark.createDataFrame([(p, "DRUM-LOOPS", t, "", *[(base | over)[n] for n in names]) for p, t, over in items], "path string, role string, sample_type string, proposed_name string, " + ", ".join(f"{n} double" for n in names))


def test_near_duplicates_keep_the_canonical_row(spark):
    df = loops(spark, ("PACKS/a/beat loop.flac", "loop", {}), ("PACKS/a/beat loop.wav", "loop", {}), ("PACKS/a/beat loop.wav", "loop", {}), ("CURATED/x/beat.ogg", "loop", {"sub_ratio": 0.55}), ("PACKS/b/beat.mp3", "loop", {"sub_ratio": 0.9}), ("PACKS/a/beat.aif", "one-shot", {}), ("PACKS/a/beat2.wav", "loop", {}), ("PACKS/z/beat.wav", "loop", {"duration_s": 2.0}))
    got = neardupe.groups(df, 0.9)
    assert rows(got, "keep_path", "path", "confidence") == [("CURATED/x/beat.ogg", "PACKS/a/beat loop.flac", "high"), ("CURATED/x/beat.ogg", "PACKS/a/beat loop.wav", "high"), ("CURATED/x/beat.ogg", "PACKS/b/beat.mp3", "high")]
    assert rows(got, "group_id")[0] == ("DRUM-LOOPS:loop:beat",) and got.filter("path LIKE '%flac'").first()["reason"] == "long-loop;stem-family;acoustic-score=0.992"
    assert neardupe.groups(df).count() == 2 and neardupe.select_groups(got, "Beat Loop.wav").count() == 3 and neardupe.select_groups(got, limit=0).count() == 0
    assert [r["path"] for r in neardupe.interleaved(got).orderBy("seq").collect()][:2] == ["CURATED/x/beat.ogg", "PACKS/a/beat loop.flac"]
    assert neardupe.approved(spark.createDataFrame([(" Remove ",), ("keep",), (None,)], "decision string")).count() == 1


def test_conflicts_and_character_tags(spark):
    schema = "path string, sample_type string, duration double, tail_ms double"
    df = spark.createDataFrame([("CURATED/KICKS/snare-top.wav", "one-shot", 0.2, 10.0), ("CURATED/KICKS/kick.wav", "loop", 4.0, 9999.0), ("CURATED/KICKS/kick2.wav", "one-shot", None, 3500.0), ("CURATED/KICKS/kick.wav", "one-shot", 0.2, 10.0), ("PACKS/snare.wav", "loop", 9.0, None)], schema)
    got = [r["c"] for r in df.select(analysis.role_conflict(*[F.col(c) for c in df.columns]).alias("c")).collect()]
    assert [c and (c["issues"], c["reasons"]) for c in got] == [("CLAP-SNARE", "CLAP-SNARE:snare"), ("DRUM-LOOPS;long-audio", "sample_type:loop;duration=4.00s"), ("long-audio", "tail_ms=3500"), None, None]
    cols = "path string, role string, duration double, bpm string, processing_tag string, processing_reason string, sub_ratio double, tail_ms double, low_ratio double, attack_ms double, flatness double, centroid_hz double, onset_density double"
    t = spark.createDataFrame([("a/sub_rumble.wav", "KICKS", 0.5, "", "tape", "filename_suffix:Tape", 0.7, 200.0, 0.6, None, None, None, None), ("a/top-loop.wav", "DRUM-LOOPS", 2.0, "132", "", "", None, None, None, None, None, None, 9.0)], cols)
    got = [tuple(r["t"]) for r in t.select(analysis.character_tags().alias("t")).collect()]
    assert got == [("subby;short;rumble-long;tape", "sub_ratio=0.7;tail_ms=200;path:rumble;filename_suffix:Tape"), ("busy;top-132", "onset_density=9;path:top;bpm=132")]


def test_families_and_labels(spark):
    df = spark.createDataFrame([("CURATED/KICKS/kick-012-3_sa909_x.wav", "curated-sample", "CURATED"), ("CURATED/KICKS/sub/k.wav", "curated-sample", "CURATED"), ("S/AUDIO/a/b/c/d.wav", "octatrack-set-audio", "S"), ("P/k.wav", "vendor-pack-audio", "P"), ("PACKS/v/s/t/k.wav", "vendor-pack-audio", "v")], "path string, kind string, source string")
    got = [r[0] for r in df.select(analysis.crate_family(F.col("path"), F.col("kind"), F.col("source"))).collect()]
    assert got == ["CURATED/KICKS/sa909-x/kick-#-#", "CURATED/KICKS/sub", "S/AUDIO/a/b/c", "P", "PACKS/v/s"]
    means = spark.createDataFrame([(0.7, 9000.0, 0.4, 100.0, 1.0, 2.0), (0.1, 1000.0, 0.2, 500.0, 4.0, 0.5), (None, 400.0, 0.01, 2000.0, 9.0, 1.0)], "a double, b double, c double, d double, e double, f double")
    assert [r[0] for r in means.select(analysis.acoustic_label(*map(F.col, "abcdef"))).collect()] == ["subby-noisy-short", "balanced", "dark-tonal-long"]


def crate_rows(rng, n):
    out = []
    for i in range(n):
        role = rng.choice(["KICKS", "PERC", "BASS", "FX"])
        out.append((f"p{i:03}/x.wav", role, f"g{rng.randrange(4)}"))
    return out


def diverse(items, limit):
    groups = {}
    for x in items:
        groups.setdefault(x[2], []).append(x)
    out = []
    while len(out) < limit and any(groups.values()):
        for g in groups.values():
            if g and len(out) < limit:
                out.append(g.pop(0))
    return out


@pytest.mark.parametrize("any_role", [False, True])
def test_quota_fill_against_a_loop(spark, any_role):
    rng = random.Random(any_role)
    for n in (0, 7, 60):
        items, quotas, most = crate_rows(rng, n), {"PERC": 5, "KICKS": 3}, 14
        want = [x for role, q in quotas.items() for x in diverse([x for x in items if x[1] == role], q)]
        seen = {x[0] for x in want}
        left = [x for x in items if x[0] not in seen] if any_role else [x for role in quotas for x in items if x[1] == role and x[0] not in seen]
        want = (want + diverse(left, most - len(want)))[:most]
        got = select.quota_fill(spark.createDataFrame(items, "path string, role string, g string"), quotas, ["g"], most, any_role).orderBy("place").collect()
        assert [r["path"] for r in got] == [x[0] for x in want]


def test_role_audits(spark):
    votes = spark.createDataFrame([("CURATED/KICKS/p/a.wav", "KICKS", "snr", 0.9), ("CURATED/KICKS/p/b.wav", "KICKS", "kick", 0.9), ("CURATED/KICKS/q/c.wav", "KICKS", "zap", 0.6), ("CURATED/BASS/p/d.wav", "BASS", "kick", 0.8), ("CURATED/PERC/../e.wav", "PERC", "hhc", 0.81)], "path string, current_role string, top_class string, top_prob double")
    a = audit.derive(votes)
    assert rows(audit.summary(a)) == [("BASS", 1, 0, 0, 0, 1), ("KICKS", 3, 2, 1, 1, 0), ("PERC", 1, 1, 1, 0, 0)]
    assert rows(audit.mismatches(a), "path", "suggested_role") == [("CURATED/KICKS/p/a.wav", "CLAP-SNARE"), ("CURATED/PERC/../e.wav", "HATS-CYM")]
    assert rows(audit.violations(a)) == [("CURATED/BASS/p/d.wav", "unsupported source role"), ("CURATED/PERC/../e.wav", "outside its role's folder")]
    assert [r["current_role"] for r in audit.routes(audit.mismatches(a)).orderBy("place").collect()] == ["KICKS", "PERC"]


def test_calibration_against_a_loop(spark):
    rng = random.Random(1)
    items = [(f"CURATED/KICKS/g{rng.randrange(5)}/{i:03}", "KICKS", rng.choice(["PERC", "BASS"]), round(0.8 + rng.random() / 5, 3)) for i in range(60)]
    items = [(*x, x[0].split("/")[2]) for x in items]
    got = audit.calibration(spark.createDataFrame(items, "path string, current_role string, suggested_role string, top_prob double, source_group string"), 6).collect()
    for route in ("PERC", "BASS"):
        left = sorted(x for x in items if x[2] == route)
        chosen = [min(left, key=lambda x: (x[3], x[0]))]
        while len(chosen) < 6:
            rest = [x for x in left if x not in chosen]
            chosen.append(min(rest, key=lambda x: (x[4] in {c[4] for c in chosen}, -min(abs(x[3] - c[3]) for c in chosen), x[0])))
        assert sorted(r["path"] for r in got if r["suggested_role"] == route) == sorted(x[0] for x in chosen)


def test_freeze_refuses_other_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    assert rows(audit.freeze(spark, df, f"{tmp_path}/b"), "i") == rows(audit.freeze(spark, df.orderBy(F.desc("i")), f"{tmp_path}/b"), "i") == [(1,), (2,)]
    with pytest.raises(ValueError, match="another content"):
        audit.freeze(spark, df.limit(1), f"{tmp_path}/b")


RATE = 22050


def sine(hz, seconds, level=0.8):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)).astype("float32")


def test_measures_of_known_signals(spark):
    rng = np.random.default_rng(0)
    click = np.zeros(RATE // 4, "float32")
    click[100:110] = 1.0
    pad = sine(220, 3.0) * np.linspace(0, 1, RATE * 3).astype("float32")[::-1]
    waves = {"sine": sine(50, 1.0), "noise": rng.uniform(-1, 1, RATE).astype("float32"), "click": click, "pad": pad.astype("float32"), "silent": np.zeros(2000, "float32"), "empty": np.zeros(0, "float32")}
    df = spark.createDataFrame([(k, RATE, [float(x) for x in v], None) for k, v in waves.items()] + [("bad", None, None, "not a wave")], "path string, rate int, signal array<float>, error string")
    got = {r["path"]: r for r in signals.features(df, "path").collect()}
    assert got["sine"]["sub_ratio"] > 0.85 and got["sine"]["flatness"] < 0.05 and got["sine"]["centroid_hz"] < 90 and math.isclose(got["sine"]["crest"], 2**0.5, rel_tol=1e-3)
    assert got["noise"]["flatness"] > 0.45 and got["noise"]["centroid_hz"] > 4500 and got["noise"]["zcr"] > 0.35
    assert got["click"]["attack_ms"] < 5 and got["click"]["tail_ms"] < 100 and math.isclose(got["click"]["head_silence_ms"], 100 / RATE * 1000)
    assert got["pad"]["tail_ms"] > 1000 and got["pad"]["onset_density"] < 2
    assert got["silent"]["peak"] == 0 and got["silent"]["error"] is None and got["empty"]["error"] and got["bad"]["error"] == "not a wave"


def test_sync_measures_what_nothing_else_knows(spark):
    items = spark.createDataFrame([("a", "p/a.wav", 10, 1, "a.wav"), ("b", "p/b.wav", 10, 2, "b.wav"), ("b", "q/b.wav", 10, 2, "b.wav"), ("c", "p/c.wav", 11, 3, "c.wav"), ("d", "p/d.wav", 12, 4, "d.wav"), ("e", "p/e.wav", 13, 5, "e.wav")], "sample_id string, path string, size long, mtime_ms long, name string")
    legacy = spark.createDataFrame([(10, 2, "b.wav", '{"x":1}'), (11, 3, "m.wav", '{"x":2}'), (11, 3, "n.wav", '{"x":3}')], "size long, mtime_ms long, name string, payload string")
    waves = spark.createDataFrame([("p/c.wav", RATE, [0.1] * 10, None), ("p/d.wav", None, None, "corrupt")], "path string, rate int, signal array<float>, error string")
    new, counters = signals.sync(items, items.filter("sample_id = 'a'"), legacy, waves)
    got = {r["sample_id"]: (r["payload"][:7], r["error"]) for r in new.collect()}
    assert set(got) == {"b", "c", "d", "e"} and got["b"] == ('{"x":1}', None) and got["c"][1] is None and got["d"] == ("{}", "corrupt") and got["e"] == ("{}", "no such file")
    assert rows(counters) == [("extracted", 1), ("failed", 2), ("migrated", 1), ("skipped", 1)]
    cache = spark.createDataFrame([("p", 1, 2.0, 5.0, None), ("q", 1, 2.0, 5.0, "bad"), ("r", 9, 2.0, 5.0, "")], "path string, size long, mtime double, v double, error string")
    asked = spark.createDataFrame([("p", 1, 2.0), ("q", 1, 2.0), ("r", 1, 2.0)], "path string, size long, mtime double")
    assert rows(signals.cached(asked, cache), "path", "v") == [("p", 5.0)]


def test_state_tables(spark):
    scan = lambda *x: spark.createDataFrame([(p, i, 1, 1) for p, i in x], "path string, sample_id string, size long, mtime_ms long")
    none = scan(("x", "x")).limit(0).withColumns({"scan_id": F.lit(""), "exists_now": F.lit(True)})
    one = catalog.finish_scan(none, scan(("a", "1"), ("b", "2")), "s1")
    two = catalog.finish_scan(one, scan(("b", "3"), ("c", "2")), "s2")
    assert rows(two, "path", "sample_id", "scan_id", "exists_now") == [("a", "1", "s1", False), ("b", "3", "s2", True), ("c", "2", "s2", True)]
    scans = catalog.scan_row(one, "s1", "/l", "t0", "t1").unionByName(catalog.scan_row(two, "s2", "/l", "t2"))
    assert rows(catalog.latest_complete(scans), "scan_id", "file_count") == [("s1", 2)] and catalog.latest_complete(scans.limit(0)).count() == 0
    assets = spark.createDataFrame([("1", "t0")], "sample_id string, first_seen_at string")
    assert rows(catalog.first_seen(assets, spark.createDataFrame([("1", "t9"), ("2", "t9")], assets.schema), "sample_id")) == [("1", "t0"), ("2", "t9")]
    pairs = spark.createDataFrame([("1", "x")], "sample_id string, tag string")
    assert rows(catalog.insert_or_ignore(pairs, pairs.unionByName(spark.createDataFrame([("2", "y")], pairs.schema)))) == [("1", "x"), ("2", "y")]
    kept, bad = catalog.insert_only(pairs, spark.createDataFrame([("1", "z"), ("2", "y"), ("3", "a"), ("3", "b")], pairs.schema), ["sample_id"])
    assert rows(kept) == [("1", "x"), ("2", "y")] and rows(bad) == [("1",), ("3",)]
    tagged = spark.createDataFrame([("1", "a", "rule"), ("1", "b", "ear")], "sample_id string, tag string, source string")
    assert rows(catalog.regenerate(tagged, pairs)) == [("1", "b", "ear"), ("1", "x", "rule")]
    picks = spark.createDataFrame([("1", "k", "q", "t1")], "sample_id string, kit string, query string, picked_at string")
    assert rows(catalog.upsert_picks(picks, spark.createDataFrame([("1", "k", "r", "t2"), ("1", "k", "s", "t3")], picks.schema))) == [("1", "k", "s", "t3")]
    assert rows(catalog.identified(spark.createDataFrame([("b",), ("zz",)], "path string"), two, "s2")) == [("s2", "", "zz"), ("s2", "3", "b")]
    assert catalog.lookup(two, "path", "b").first()["sample_id"] == "3"
    with pytest.raises(Exception, match="no path"):
        catalog.lookup(two, "path", "nope").collect()
    assert rows(catalog.under(paths_of(spark, "a/b/c", "a/bc", "d"), spark.createDataFrame([("a/b",), ("d",)], "prefix string")), "prefix", "path") == [("a/b", "a/b/c"), ("d", "d")]


def test_promotions_and_views(spark):
    sid = "a" * 64
    labels = spark.createDataFrame([(2, sid, "PACKS/v/k.wav", "favourite", "KICK", "Deep One", "tone:dark"), (3, "b" * 64, "PACKS/v/s.wav", "keep", "", "", "")], "row long, sample_id string, current_path string, decision string, true_role string, descriptor string, tags string")
    loc = spark.createDataFrame([("PACKS/v/k.wav", sid), ("PACKS/v/s.wav", "b" * 64)], "path string, sample_id string")
    packet = spark.createDataFrame([("s1", "/l")], "scan_id string, root string")
    plan, faults = curation.promote(labels, packet, packet, loc, loc)
    assert faults.count() == 0 and rows(plan, "curated_path") == [("CURATED/KICK/kick_deep-one_v_aaaaaaaa.wav",)]
    there = loc.unionByName(spark.createDataFrame([("CURATED/KICK/kick_deep-one_v_aaaaaaaa.wav", sid)], loc.schema))
    assert rows(curation.promote(labels, packet, packet, loc, there)[1], "violation") == [("curated destination exists",)]
    views, short = curation.consumer_views(labels, plan, {"KICK": 2})
    assert rows(views, "crate") == [("foundation-v1-all",), ("foundation-v1-one-shots",)] and rows(short, "violation") == [("quota shortage: KICK 1",)]
    assert rows(curation.consumer_views(labels, plan.limit(0), {})[1], "violation") == [("favourite has not been promoted",)]
    assert rows(curation.undo(plan), "path") == [("CURATED/KICK/kick_deep-one_v_aaaaaaaa.wav",)]


def test_search_index_and_runs(spark):
    loc = spark.createDataFrame([("1", "PACKS/v/kick_deep.wav"), ("1", "CURATED/KICKS/kick.wav"), ("2", "PACKS/v/bass-one-a_v.wav"), ("3", "PACKS/w/bass-one-a-2_v.wav")], "sample_id string, path string")
    tag_rows = spark.createDataFrame([("1", "tone", "dark"), ("1", "role", "kick"), ("2", "tone", "warm")], "sample_id string, tag_group string, tag string")
    ix = find.index(loc, spark.createDataFrame([("1", "v")], "sample_id string, origin string"), tag_rows, spark.createDataFrame([("3", 2)], "sample_id string, picks long"))
    assert [(r["path"], r["origin"], r["tags"], r["picks"]) for r in ix.orderBy("sample_id").collect()] == [("CURATED/KICKS/kick.wav", "v", ["dark"], 0), ("PACKS/v/bass-one-a_v.wav", "unknown", ["warm"], 0), ("PACKS/w/bass-one-a-2_v.wav", "unknown", [], 2)]
    assert [r["sample_id"] for r in find.run(ix, "picks", 2).orderBy("place").collect()] == ["3", "1"] and find.run(ix, limit=1).first()["total"] == 3
    assert rows(tags.search(ix, ("bass-one-a-v.wav",)), "sample_id") == [("2",)]  # a whole part, with _ read as -
    assert find.resolve(ix, "kick.wav").first()[0] == "1" and find.resolve(ix, "2").first()[0] == "2"
    for bad in ("bass", "nothing"):
        with pytest.raises(Exception, match="matches"):
            find.resolve(ix, bad).collect()
    assert find.describe(("a",), {"role": ("kicks",)}, True) == "a role=kicks zone=CURATED" and find.describe() == "(all)"
    samples = ix.select("sample_id", "path", "role", "origin")
    got = find.regenerate(samples, [Rule("deep", "style", name_matches=("kick",))], samples)
    assert ("1", "style", "deep") in rows(got, "sample_id", "tag_group", "tag") and ("1", "origin", "v") in rows(got, "sample_id", "tag_group", "tag")


def test_benchmarks(spark):
    files = paths_of(spark, "CURATED/KICKS/a/1.wav", "CURATED/KICKS/a/2.wav", "CURATED/KICKS/b/3.wav", "CURATED/PERC/b/4.wav", "CURATED/KICKS/b/._5.wav", "CURATED/KICKS/x.txt")
    feats = spark.createDataFrame([("CURATED/KICKS/a/1.wav", 100.0, 0.1, 0.8), ("CURATED/KICKS/a/2.wav", 100.0, 0.1, 4.0)], "path string, centroid_hz double, sub_ratio double, duration_s double")
    assert benchmark.items(files, feats, "KICKS").count() == 3 and rows(benchmark.items(files, feats, "KICKS", 2.5), "path") == [("CURATED/KICKS/a/1.wav",)]
    labels = spark.createDataFrame([("p", "KICKS"), ("q", "VOCALS"), ("r", ""), ("s", "NOPE")], "path string, true_role string")
    assert rows(benchmark.label_violations(labels, benchmark.SCORED)) == [("r", "unlabelled row"), ("s", "invalid true_role")]
    pairs = benchmark.truth(labels.limit(2), spark.createDataFrame([("p", "KICKS")], "path string, predicted string"))
    assert rows(pairs) == [("p", "KICKS", "KICKS"), ("q", "VOCALS", "OTHER")]
    card = {r["role"]: r for r in benchmark.scorecard(pairs).collect()}
    assert card["KICKS"]["f1"] == 1 and card["VOCALS"]["recall"] == 0 and card["PERC"]["support"] == 0 and card["OTHER"]["accuracy"] == 0.5


def test_a_whole_run(spark):
    rng = np.random.default_rng(3)
    names = [f"PACKS/v{i % 4}/s/{w} {i}.wav" for i, w in enumerate(["kick", "snare", "hat", "conga", "bass", "drone"] * 12)]
    files = paths_of(spark, *names, *SET_FILES)
    src = sets.sources(files)
    measures = [(p, *[float(x) for x in rng.random(16)], "") for p in names]
    m = spark.createDataFrame(measures, "path string, " + ", ".join(f"{x} double" for x in signals.MEASURES) + ", audio_error string").withColumn("duration_s", F.col("duration_s") + 0.1)
    r = report.feature_rows(src, m).cache()
    assert r.count() == len(names) + 4 and {"gate", "conflict", "character_tags"} <= set(r.columns)
    groups = report.cluster_report(r).cache()
    assert groups.groupBy("role", "cluster_label").agg(F.sum(F.col("representative").cast("int")).alias("n")).filter("n <> 1").count() == 0
    crates = report.crates(r, groups, sets.registry(files)).cache()
    assert crates.filter("crate LIKE '%-set.txt'").count() == 2 and crates.groupBy("crate", "path").count().filter("count > 1").count() == 0
    counts = {(x["section"], x["name"]): x["n"] for x in report.counts(r, groups, crates).collect()}
    assert counts["kind", "octatrack-set-audio"] == 2 and {("gate", g) for g in report.GATES} <= set(counts)
    assert report.gate_audit(r).filter("action = 'decode-or-manual-review'").count() == 2


def test_rule_files_and_sheets(spark, tmp_path):
    good = tmp_path / "v.toml"
    good.write_text('schema_version = 1\n[[tag]]\nname = "Deep"\ngroup = "tone"\nroles = ["KICKS"]\nname_matches = ["Deep"]\nfeatures = {sub_ratio = ">=0.60"}\n')
    assert io.read_rules(str(good)) == [Rule("deep", "tone", name_matches=("deep",), roles=("KICKS",), features=(("sub_ratio", ">=", 0.6),))]
    for text in ("schema_version = 2", 'schema_version = 1\n[[tag]]\nname = "x"', 'schema_version = 1\n[[tag]]\nname="a"\ngroup="b"\n[[tag]]\nname="A"\ngroup="b"', 'schema_version = 1\n[[tag]]\nname="a"\ngroup="b"\nfeatures={x="~1"}'):
        good.write_text(text)
        with pytest.raises(ValueError):
            io.read_rules(str(good))
    (tmp_path / "f.tsv").write_text("path\tcentroid_hz\nx\t1.5\ny\t\n")
    assert rows(io.read_lookup(spark, str(tmp_path / "f.tsv")).fillna(-1.0)) == [("x", 1.5, -1.0, -1.0), ("y", -1.0, -1.0, -1.0)]
    (tmp_path / "g.tsv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="path"):
        io.read_lookup(spark, str(tmp_path / "g.tsv"))
    for role in ("KICKS", "PERC"):
        (tmp_path / role).mkdir()
        (tmp_path / role / "labels.tsv").write_text(f"path\ttrue_role\nx\t {role} \n")
    assert rows(io.read_labels(spark, f"{tmp_path}/*/labels.tsv"), "true_role") == [("KICKS",), ("PERC",)]
    review = spark.createDataFrame([("a", "KICKS", "high", "unknown"), ("b", "_REVIEW", "low", "unknown")], "source string, role string, confidence string, tempo_fit string")
    io.write_review(review, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/review-needed").count() == 1 and rows(spark.read.parquet(f"{tmp_path}/out/by-role"), "path") == [("a",)]
    io.append_log(review, f"{tmp_path}/log")
    io.append_log(review, f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/log", sep="\t").count() == 4
    io.write_crates(spark.createDataFrame([("c", 1, "p")], "crate string, place int, path string"), f"{tmp_path}/crates")
    assert spark.read.option("header", True).csv(f"{tmp_path}/crates", sep="\t").count() == 1
