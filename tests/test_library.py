"""Sources, sinks, gates and clustering on small inputs."""

import gzip
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelake.functions import names, paths
from cratelake.operators import cluster, ladders, tags
from cratelake.sources import files


def _wave(path, seconds=0.5, hz=50.0, rate=44100):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "w") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(20000 * math.sin(2 * math.pi * hz * i / rate))) for i in range(int(seconds * rate))))


def test_scan_and_content_ids(spark, tmp_path):
    for p in ("PACKS/a/kick.wav", "CATALOGUE/kick copy.wav", "_EXPORT/x.wav", "PACKS/.hidden/y.wav", "PACKS/a/__MACOSX/z.wav"):
        _wave(tmp_path / p)
    (tmp_path / "PACKS/a/notes.txt").write_text("no audio")
    seen = files.scan_library(spark, str(tmp_path))
    assert {r.path for r in seen.collect()} == {"PACKS/a/kick.wav", "CATALOGUE/kick copy.wav"}
    known = seen.filter("path LIKE 'PACKS%'").withColumn("sample_id", F.lit("cached"))
    got = {r.path: r.sample_id for r in files.content_ids(spark, str(tmp_path), known).collect()}
    assert got["PACKS/a/kick.wav"] == "cached" and len(got["CATALOGUE/kick copy.wav"]) == 64


def test_waves(spark, tmp_path):
    _wave(tmp_path / "good.wav")
    (tmp_path / "bad.wav").write_bytes(b"not a wave")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.read_waves(spark, str(tmp_path)).collect()}
    assert rows["good.wav"].rate == 22050 and len(rows["good.wav"].signal) == 11025 and rows["good.wav"].error is None
    assert rows["bad.wav"].signal is None and rows["bad.wav"].error


def test_projects(spark, tmp_path):
    xml = b'<A><Tempo><Manual Value="138"/></Tempo><Tracks><T><Name><EffectiveName Value="Kick"/></Name></T></Tracks><Scenes><Scene/><Scene/></Scenes></A>'
    (tmp_path / "one.als").write_bytes(gzip.compress(xml))
    (tmp_path / "empty.als").write_bytes(gzip.compress(b"<A/>"))
    (tmp_path / "corrupt.als").write_bytes(b"x")
    (tmp_path / "Backup").mkdir()
    (tmp_path / "Backup/old.als").write_bytes(gzip.compress(xml))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.read_projects(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one.als", "empty.als", "corrupt.als"}
    assert (rows["one.als"].tempo, rows["one.als"].tracks, rows["one.als"].scene_count) == (138.0, ["Kick"], 2)
    assert rows["empty.als"].tempo is None and rows["empty.als"].tracks == [] and rows["corrupt.als"].error


def test_sheets(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("path\taudio_error\tx\na\t\t1.5\nb\tbroken\t2\nc\t\tnone\nd\t\t\n")
    assert [(r.path, r.x) for r in files.read_features(spark, str(tmp_path / "f.tsv"), ("x",)).collect()] == [("a", 1.5)]
    with pytest.raises(ValueError):
        files.read_sheet(spark, str(tmp_path / "f.tsv"), ("path", "x"))
    with pytest.raises(ValueError):
        files.read_sheet(spark, str(tmp_path / "f.tsv"), ("path", "y"), exact=False)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 1), ("a", "y", 2)], "path string, role string, seq int")
    files.write_playlist(df, str(tmp_path / "list"), "/root", "seq")
    lines = [line for p in sorted((tmp_path / "list").glob("part-*")) for line in p.read_text().split()]
    assert lines == ["/root/b", "/root/a"]
    files.write_split(df, str(tmp_path / "split"), "role")
    assert {p.name for p in (tmp_path / "split").glob("role=*")} == {"role=x", "role=y"}
    files.write_sheet(df, str(tmp_path / "sheet"))
    assert files.read_sheet(spark, str(tmp_path / "sheet"), ("path", "role", "seq")).count() == 2
    one, other = files.digest(df).first(), files.digest(df.repartition(3)).first()
    assert one == other and files.digest(df.filter("seq = 1")).first() != one


def test_role_by_duration(spark):
    df = spark.createDataFrame([("zz.wav", 0.5), ("zz.wav", 2.0), ("zz.wav", None)], "path string, s double")
    got = [(r.r.role, r.r.reason) for r in df.select(ladders.role(F.col("path"), F.col("s")).alias("r")).collect()]
    assert got == [("_REVIEW", "duration:0.50<oneshot"), ("DRUM-LOOPS", "duration:2.00>=oneshot"), ("_REVIEW", "unmatched")]


def test_names(spark):
    p = F.col("path")
    df = spark.createDataFrame([("PACKS/Acme/loops/Groove 120 BPM Thing In A Minor.wav",), ("PACKS/Acme/AU_HHT_kick_balancer_Tape.wav",)], "path string")
    a, b = df.select(names.musical_key(paths.stem(p)).alias("k"), names.proposed_name(p, F.lit("DRUM-LOOPS")).alias("n"), names.descriptor(p).alias("d"), names.processing_tag(p).alias("t")).collect()
    assert (a.k, a.n) == ("am", "120_am_groove-thing_acme.wav")
    assert (b.d, b.t) == ("balancer", "tape")


def test_origins(spark):
    rows = [("s1", "CATALOGUE/samples/kick-a_sa909_samples-2.wav"), ("s2", "PACKS/Acme/kick.wav"), ("s2", "CATALOGUE/samples/kick_other.wav"), ("s3", "CATALOGUE/Vendor_Thing.wav"), ("s4", "ROOT/loops/kick_samples.wav")]
    got = {r.sample_id: (r.origin, r.confidence) for r in tags.resolve_origins(spark.createDataFrame(rows, "sample_id string, path string")).collect()}
    assert got == {"s1": ("goldbaby-super-analog-909", "guessed"), "s2": ("acme", "exact"), "s3": ("unknown", "none"), "s4": ("unknown", "none")}


def _plain_kmeans(x):
    n = len(x)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    k, picked = (1 if n < 4 else min(8, max(2, n // 30))), [0]
    while len(picked) < k:
        far = np.linalg.norm(z[:, None] - z[picked][None], axis=2).min(axis=1)
        far[picked] = -1
        picked.append(int(far.argmax()))
    c, labels = z[picked].copy(), None
    for _ in range(25 if k > 1 else 0):
        new = np.linalg.norm(z[:, None] - c[None], axis=2).argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        c = np.array([z[labels == i].mean(axis=0) if (labels == i).any() else c[i] for i in range(k)])
    d = np.linalg.norm(z[:, None] - c[None], axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_cluster(spark):
    rng = np.random.default_rng(7)
    sizes = {"A": 150, "B": 3, "C": 40, "D": 1}
    data = {r: np.round(rng.normal(size=(n, 4)) + 3 * rng.integers(0, 3, size=(n, 1)), 4) for r, n in sizes.items()}
    rows = [(r, f"{i:04d}", [float(v) for v in x]) for r, xs in data.items() for i, x in enumerate(xs)] + [("A", "9999", [1.0, None, 0.0, 0.0])]
    got = cluster.cluster(spark.createDataFrame(rows, "role string, path string, v array<double>").repartition(5), "v", 4).collect()
    assert len(got) == sum(sizes.values())
    for role, xs in data.items():
        mine = sorted((r for r in got if r.role == role), key=lambda r: r.path)
        labels, far = _plain_kmeans(xs)
        assert [r.cluster for r in mine] == labels.tolist()
        assert np.allclose([r.distance for r in mine], far)
        assert sum(r.representative for r in mine) == len(set(labels.tolist()))
