"""Signals in blocks: against closed forms, and against the measures of the whole."""

import math
import wave

import numpy as np
import pytest

from cratelake.operators import signals
from cratelake.sources import files

TIME = ("duration_s", "peak", "rms", "crest", "attack_ms", "tail_ms", "head_silence_ms", "tail_silence_ms", "onset_density", "zcr")


def save(path, signal, rate):
    with wave.open(str(path), "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", None))
        w.writeframes((np.asarray(signal) * 32767).astype("<i2").tobytes())


def test_blocks_measure_time_as_the_whole_does(spark):
    rng = np.random.default_rng(4)
    bursts = np.concatenate([np.zeros(700), rng.normal(size=9000) * np.exp(-np.arange(9000) / 2500), np.zeros(300)] * 2).astype("float32")
    size = 2048
    rows = [("b", 8000, i, bursts[a : a + size].tolist()) for i, a in enumerate(range(0, len(bursts), size))]
    rows += [("silent", 8000, i, [0.0] * size) for i in range(3)] + [("short", 8000, 0, bursts[:1500].tolist()), (None, 8000, 0, [0.5] * size), (None, 8000, 1, [math.nan, -0.5])]
    blocks = spark.createDataFrame(rows, "path string, rate int, block long, samples array<float>").repartition(3)
    got = {r.path: r for r in signals.block_features(blocks, "path", size, 1024).collect()}
    for name, signal in (("b", bursts), ("silent", np.zeros(3 * size)), ("short", bursts[:1500])):
        want = signals.measure(signal, 8000)
        assert all(got[name][m] == pytest.approx(want[m], rel=1e-5, abs=1e-9) for m in (signals.MEASURES if name != "b" else TIME))
    assert got[None]["peak"] == 0.5 and got[None]["duration_s"] == (size + 2) / 8000
    with pytest.raises(ValueError):
        signals.block_features(blocks, "path", 1000, 300)


def test_an_hour_in_bounded_memory(spark, tmp_path):
    rate, hz = 8000, 440.0
    hour = 0.5 * np.sin(2 * math.pi * hz * np.arange(3600 * rate) / rate)
    hour[: 2 * rate] = 0  # two seconds of silence
    save(tmp_path / "hour.wav", hour, rate)
    save(tmp_path / "kick.wav", hour[3 * rate : 4 * rate], rate)
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    blocks = files.read_wave_blocks(spark, str(tmp_path), rate)
    assert blocks.filter("error IS NOT NULL").count() == 1
    sound = blocks.filter("error IS NULL")
    assert max(len(r.samples) for r in sound.limit(3).collect()) <= signals.BLOCK
    got = {r.path.rsplit("/", 1)[-1]: r for r in signals.block_features(sound, "path").collect()}
    r = got["hour.wav"]
    on = 3598 / 3600
    near = lambda x, want, tol=1e-3: x == pytest.approx(want, rel=tol)
    assert r.duration_s == 3600 and near(r.peak, 0.5) and near(r.rms, 0.5 * math.sqrt(on / 2)) and near(r.crest, math.sqrt(2 / on))
    assert near(r.zcr, 2 * hz / rate * on) and near(r.head_silence_ms, 2000, 1e-3) and r.tail_silence_ms < 2 and r.attack_ms < 2
    assert near(r.centroid_hz, hz, 0.02) and r.mid_ratio > 0.999 and r.low_ratio < 1e-3 and r.high_ratio < 1e-3
    want = signals.measure(np.round(hour[3 * rate : 4 * rate] * 32767).astype("<i2") / 32768, rate)
    assert all(got["kick.wav"][m] == pytest.approx(want[m], rel=0.02, abs=1e-3) for m in signals.MEASURES)


def test_blocks_of_a_resampled_file_are_its_wave(spark, tmp_path):
    save(tmp_path / "a.wav", 0.5 * np.sin(np.arange(9000) / 7), 11025)
    whole = files.read_waves(spark, str(tmp_path), 8000).first().signal
    parts = sorted(files.read_wave_blocks(spark, str(tmp_path), 8000, 1024).collect(), key=lambda r: r.block)
    assert np.allclose(np.concatenate([p.samples for p in parts]), whole, atol=1e-6) and [len(p.samples) for p in parts[:-1]] == [1024] * (len(parts) - 1)
