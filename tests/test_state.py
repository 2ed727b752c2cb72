"""State from run to run, strict gates, and readers that open what they list."""

import gzip
import os
import wave

import pytest
from pyspark.sql import functions as F

from cratelake.functions import names
from cratelake.operators import audit, benchmark, catalog, curation, gates, inventory, plans, tags
from cratelake.sources import files
from cratelake.state import StaleVersion, State


def audio(path, frames):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", None))
        w.writeframes(frames)


def test_versions_appear_whole(spark, tmp_path):
    root = str(tmp_path / "state")
    one = State(spark, root)
    assert one.version == 0 and one.read("t", "a int").count() == 0
    rows = spark.createDataFrame([(1,)], "a int")
    two = one.commit(t=rows, u=rows)
    three = two.commit(t=two.read("t", "a int").unionByName(spark.createDataFrame([(2,)], "a int")))
    assert sorted(r.a for r in three.read("t", "a int").collect()) == [1, 2] and three.read("u", "a int").count() == 1
    assert [r.a for r in two.read("t", "a int").collect()] == [1]  # an older version can be read on
    with pytest.raises(StaleVersion):
        two.commit(t=rows)
    with pytest.raises(Exception, match="no way"):
        three.commit(u=rows, t=rows.select(F.raise_error(F.lit("no way")).cast("int").alias("a")))
    assert State(spark, root).version == three.version
    (tmp_path / "state/commits" / f"{three.version + 1:08}").touch()  # a writer that died at its marker
    four = State(spark, root).commit(t=rows)
    assert four.version == three.version + 2 and four.read("t", "a int").count() == 1 and four.read("u", "a int").count() == 1
    assert four.vacuum() > 0 and four.vacuum() == 0
    assert State(spark, root).read("u", "a int").count() == 1


def test_two_scans_and_a_third_that_breaks_off(spark, tmp_path, monkeypatch):
    lib, root = tmp_path / "lib", str(tmp_path / "state")
    audio(lib / "PACKS/a/kick.wav", b"\x01\x02" * 50)
    audio(lib / "PACKS/a/snare.wav", b"\x03\x04" * 50)
    run = lambda i: inventory.scan(spark, root, str(lib), f"scan{i}", f"t{i}", lambda: f"t{i}.5")
    run(1)
    audio(lib / "PACKS/b/hat.wav", b"\x05\x06" * 50)
    (lib / "PACKS/a/snare.wav").unlink()
    two = run(2)
    before = sorted(map(tuple, two.read("locations", inventory.LOCATIONS).collect()))
    assert [(r[0], r[4], r[5]) for r in before] == [("PACKS/a/kick.wav", "scan2", True), ("PACKS/a/snare.wav", "scan1", False), ("PACKS/b/hat.wav", "scan2", True)]
    audio(lib / "PACKS/b/tom.wav", b"\x07\x08" * 50)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(inventory.catalog, "first_seen", fail)
        with pytest.raises(RuntimeError, match="lost"):
            run(3)
    broken = State(spark, root)
    assert sorted(map(tuple, broken.read("locations", inventory.LOCATIONS).collect())) == before
    assert {(r.scan_id, r.status) for r in broken.read("scans", inventory.SCANS).collect()} == {("scan1", "complete"), ("scan2", "complete"), ("scan3", "incomplete")}
    assert inventory.current(broken).count() == 2
    done = run(3)
    assert {(r.scan_id, r.status, r.file_count) for r in done.read("scans", inventory.SCANS).collect()} == {("scan1", "complete", 2), ("scan2", "complete", 2), ("scan3", "complete", 3)}
    assert {r.path for r in inventory.current(done).collect()} == {"PACKS/a/kick.wav", "PACKS/b/hat.wav", "PACKS/b/tom.wav"}
    assert sorted(r.first_scan for r in done.read("assets", inventory.ASSETS).collect()) == ["scan1", "scan1", "scan2", "scan3"]


def test_records_from_run_to_run(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    of = spark.createDataFrame
    state = inventory.record_picks(state, of([("1", "k", "q", "t1"), ("2", "k", "q", "t1")], inventory.PICKS))
    state = inventory.record_picks(state, of([("1", "k", "r", "t2")], inventory.PICKS))
    assert sorted((r.sample_id, r.query) for r in state.read("picks", inventory.PICKS).collect()) == [("1", "r"), ("2", "q")]
    state = inventory.record_tags(state, of([("1", "mood", "dark", "hand")], inventory.TAGS), "hand")
    state = inventory.record_tags(state, of([("1", "form", "loop", "rule")], inventory.TAGS))
    state = inventory.record_tags(state, of([("2", "form", "hit", "rule")], inventory.TAGS))
    assert sorted((r.sample_id, r.tag) for r in state.read("tags", inventory.TAGS).collect()) == [("1", "dark"), ("2", "hit")]
    state = inventory.record_reviews(state, of([("1", "r1", "keep", "", "", "")], inventory.REVIEWS))
    state = inventory.record_reviews(state, of([("1", "r1", "reject", "", "", ""), ("1", "r2", "keep", "", "", "")], inventory.REVIEWS))
    assert sorted((r.run_id, r.decision) for r in state.read("reviews", inventory.REVIEWS).collect()) == [("r1", "reject"), ("r2", "keep")]
    state = inventory.record_promotions(state, of([("1", "CURATED/a", "p", "r1")], inventory.PROMOTIONS))
    with pytest.raises(Exception, match="promotion exists"):
        inventory.record_promotions(state, of([("1", "CURATED/a", "p", "r2"), ("2", "CURATED/b", "p", "r2")], inventory.PROMOTIONS))
    assert state.refresh().read("promotions", inventory.PROMOTIONS).count() == 1


ID, OTHER = "a" * 64, "b" * 64


def faults(spark, kind):
    """(rows, violations, key, the rows that are sound, how many faults) of each gate, with faults and without."""
    of = spark.createDataFrame
    if kind == "labels":
        schema = "row long, sample_id string, decision string, true_role string, descriptor string, tags string"
        bad = [(1, ID, "favourite", "KICK", "deep", ""), (2, "x", "favourite", "KICK", "deep", ""), (3, ID, "maybe", "", "", "")]
        return [(rows := of(r, schema), tags.label_violations(rows, ("KICK",)), "row", 1, n) for r, n in ((bad, 2), (bad[:1], 0))]
    if kind == "collisions":
        plan = of([(1, "CURATED/a"), (2, "CURATED/b")], "row long, curated_path string")
        return [(plan, curation.collisions(plan, of([(p,)], "path string")), "row", 2 - n, n) for p, n in (("CURATED/a", 1), ("c", 0))]
    if kind == "freshness":
        packet = of([("s1", "/lib")], "scan_id string, root string")
        rows = of([(1,)], "row long")
        return [(rows, curation.freshness(packet, of([(s, "/lib")], "scan_id string, root string")), "row", 1, n) for s, n in (("s2", 1), ("s1", 0))]
    if kind == "truth":
        schema = "path string, true_role string"
        return [(rows := of(r, schema), benchmark.label_violations(rows, ("kick",)), "path", 1, n) for r, n in (([("a", "kick"), ("b", ""), (None, "x")], 2), ([("a", "kick")], 0))]
    schema = "path string, current_role string, suggested_role string"
    good = ("CURATED/KICKS/k.wav", "KICKS", "PERC")
    return [(rows := of(r, schema), audit.violations(rows), "path", 1, n) for r, n in (([good, ("PACKS/k.wav", "KICKS", "PERC")], 1), ([good], 0))]


@pytest.mark.parametrize("kind", ["labels", "collisions", "freshness", "truth", "audit"])
def test_gates_in_both_modes(spark, kind):
    for rows, violations, key, sound, n in faults(spark, kind):
        kept, found = gates.gate(rows, violations, key)
        assert found.count() == n
        null_row = kind == "truth" and n  # a row whose key is null can't be told from the whole table
        assert kept.count() == sound + bool(null_row)
        must, _ = gates.gate(rows, violations, key, must=True)
        if n:
            for read in (must.collect, must.count, must.select(key).collect, must.limit(1).collect):
                with pytest.raises(Exception, match=f"{n} violations"):
                    read()
            with pytest.raises(Exception, match="violation"):
                gates.strict(rows.limit(0), violations).count()
        else:
            assert sorted(map(tuple, must.collect())) == sorted(map(tuple, rows.collect()))


def test_crates_and_names_in_strict_mode(spark):
    crate = spark.createDataFrame([(1, ID, "CURATED/a.wav", "KICK", "deep", ""), (2, OTHER, "CURATED/b.wav", "NOPE", "deep", "")], "row long, sample_id string, source_path string, role string, descriptor string, reason string")
    where = spark.createDataFrame([("CURATED/a.wav", ID, 1.0), ("CURATED/b.wav", OTHER, 1.0)], "path string, sample_id string, duration double")
    plan, found = plans.crate_plan(crate, "My Crate", where, plans.devices(spark), "digitakt")
    assert plan.count() == 2 and [tuple(r) for r in found.collect()] == [(2, "unknown role")]
    with pytest.raises(Exception, match="unknown role"):
        plans.crate_plan(crate, "My Crate", where, plans.devices(spark), "digitakt", must=True)[0].count()
    assert plans.crate_plan(crate.filter("row = 1"), "My Crate", where, plans.devices(spark), "digitakt", must=True)[0].count() == 1
    name = names.compact_name(F.col("role"), F.col("row"), F.col("descriptor"), F.col("sample_id"), must=True)
    assert [r[0] for r in crate.filter("row = 1").select(name).collect()] == ["BD01_deep_aaaa.wav"]
    with pytest.raises(Exception, match="unknown role NOPE"):
        crate.select(name).collect()


def test_lookups_fail_however_they_are_read(spark):
    rows = spark.createDataFrame([("a", 1)], "path string, n int")
    assert catalog.lookup(rows, "path", "a").count() == 1
    with pytest.raises(Exception, match="no path 'b'"):
        catalog.lookup(rows, "path", "b").count()


def test_only_new_files_are_opened_and_long_ones_stream(spark, tmp_path):
    for i in range(6):
        audio(tmp_path / f"PACKS/a b%20/k{i}.wav", bytes([i, 0]) * 100)
    opened = spark.sparkContext.accumulator(0)
    first = files.content_ids(spark, str(tmp_path), spark.createDataFrame([], "path string, length long, modificationTime timestamp, sample_id string"), opened)
    cache = spark.createDataFrame(first.collect(), first.schema)
    assert opened.value == 6 and cache.select("sample_id").distinct().count() == 6
    audio(tmp_path / "PACKS/a b%20/k1.wav", b"\x09\x00" * 200)
    with open(tmp_path / "PACKS/huge.wav", "wb") as f:
        f.truncate((1 << 31) + 7)  # sparse
    again = spark.sparkContext.accumulator(0)
    got = {r.path: r.sample_id for r in files.content_ids(spark, str(tmp_path), cache, again).collect()}
    assert again.value == 2 and len(got) == 7
    old = {r.path: r.sample_id for r in cache.collect()}
    assert {p for p in old if old[p] != got[p]} == {"PACKS/a b%20/k1.wav"}
    assert got["PACKS/huge.wav"] == os.popen(f"sha256sum '{tmp_path}/PACKS/huge.wav'").read()[:64]


SET = b"""<?xml version="1.0"?><Live><LiveSet><Tracks>
<GroupTrack><Name><EffectiveName Value="Drums"/></Name><DeviceChain><Devices><DrumBuss/></Devices></DeviceChain>
  <MidiTrack><Name><EffectiveName Value="Kick"/></Name><DeviceChain><Devices><Operator/><Eq8/></Devices></DeviceChain></MidiTrack></GroupTrack>
<AudioTrack><Name><EffectiveName Value="Bass"/></Name></AudioTrack><AudioTrack><Name><EffectiveName Value=""/></Name></AudioTrack>
<ReturnTrack><Name><EffectiveName Value="A"/></Name></ReturnTrack></Tracks>
<Scenes><Scene Name="Intro"/><Scene><Name Value="Drop"/></Scene><Scene/></Scenes>
<MasterTrack><DeviceChain><Mixer><Tempo><Manual Value="138"/></Tempo></Mixer><DeviceChain><Devices><Reverb Id="0"/><Delay Id="1"/></Devices></DeviceChain></DeviceChain></MasterTrack>
</LiveSet></Live>"""


def test_projects_with_nested_tracks_scenes_and_devices(spark, tmp_path):
    (tmp_path / "a.als").write_bytes(gzip.compress(SET))
    (tmp_path / "b.als").write_bytes(gzip.compress(b'<?xml version="1.0"?><Live><LiveSet></LiveSet></Live>'))
    (tmp_path / "cut.als").write_bytes(gzip.compress(SET)[:-20])
    (tmp_path / "._a.als").write_bytes(b"x")
    projects = files.read_projects(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in projects.collect()}
    a, b = rows["a.als"], rows["b.als"]
    assert (a.tempo, a.tracks, a.scene_count, a.scenes) == (138.0, ["Kick", "Bass"], 3, ["Intro", "Drop", ""])
    assert a.devices == ["DrumBuss", "Operator", "Eq8", "Reverb", "Delay"]
    assert [(c.track, c.kind, c.depth, c.devices) for c in a.chains][:3] == [("Drums", "GroupTrack", 0, ["DrumBuss"]), ("Kick", "MidiTrack", 1, ["Operator", "Eq8"]), ("Bass", "AudioTrack", 0, [])]
    assert (b.tempo, b.tracks, b.scene_count, b.devices, b.error) == (None, [], 0, [], None)
    assert set(rows) == {"a.als", "b.als", "cut.als"} and rows["cut.als"].error
    index = {r.path[-5]: r for r in files.project_index(projects).collect()}
    assert (index["a"].tempo, index["a"].track_count, index["a"].tracks, index["a"].devices) == ("138.0", 2, "Kick,Bass", "DrumBuss,Operator,Eq8,Reverb,Delay") and index["b"].tempo == ""
    devices = [(r.track, r.position, r.device) for r in files.project_devices(projects).orderBy("place", "position").collect()]
    assert devices == [("Drums", 0, "DrumBuss"), ("Kick", 0, "Operator"), ("Kick", 1, "Eq8"), (None, 0, "Reverb"), (None, 1, "Delay")]
