"""Measures of signals, and the job that keeps them up to date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratelake.operators import catalog
from cratelake.staging import staged

# Names and limits of the measures.
MEASURES = (
    "duration_s", "peak", "rms", "crest", "attack_ms", "tail_ms", "head_silence_ms", "tail_silence_ms", "centroid_hz", "flatness", "sub_ratio", "low_ratio", "mid_ratio", "high_ratio",
    "onset_density", "zcr",
)
BANDS = {"sub_ratio": (0.0, 120.0), "low_ratio": (0.0, 250.0), "mid_ratio": (250.0, 4000.0), "high_ratio": (4000.0, None)}
ACTIVE, RISEN, FRAME, HOP, EPS = 0.01, 0.9, 1024, 512, 1e-12


def measure(signal: np.ndarray, rate: int) -> dict[str, float]:
    """The measures of one mono signal; silent and empty ones have zeros."""
    x = np.nan_to_num(np.asarray(signal, np.float32))
    out = dict.fromkeys(MEASURES, 0.0)
    if not len(x):
        return out
    level = np.abs(x)
    peak, rms, seconds = float(level.max()), float(np.sqrt(np.mean(np.square(x)))), len(x) / rate
    out |= {"duration_s": seconds, "peak": peak, "rms": rms, "crest": peak / rms if rms > EPS else 0.0}
    if peak > EPS:
        loud = np.flatnonzero(level >= max(peak * ACTIVE, EPS))
        first, last, top = int(loud[0]), int(loud[-1]), int(level.argmax())
        risen = first + int((level[first:] >= peak * RISEN).argmax())
        ms = 1000.0 / rate
        out |= {"attack_ms": (risen - first) * ms, "tail_ms": (last - top) * ms, "head_silence_ms": first * ms, "tail_silence_ms": (len(x) - 1 - last) * ms}
    spectrum = np.abs(np.fft.rfft(x * np.hanning(len(x))))
    power, hz = np.square(spectrum), np.fft.rfftfreq(len(x), 1.0 / rate)
    if power.sum() > EPS and spectrum.sum() > EPS:
        out["centroid_hz"] = float((hz * spectrum).sum() / spectrum.sum())
        out["flatness"] = float(np.exp(np.log(power + EPS).mean()) / (power.mean() + EPS))
        for name, (low, high) in BANDS.items():
            out[name] = float(power[(hz >= low) & (hz < (rate / 2 + 1 if high is None else high))].sum() / power.sum())
    if len(x) >= FRAME:
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        rise = np.maximum(0.0, np.diff(np.sqrt(np.mean(np.square(frames), axis=1)).astype(np.float32)))
        if len(rise) >= 2 and rise.max() > EPS:
            mid = rise[1:-1]
            out["onset_density"] = float(((mid > rise.mean() + rise.std()) & (mid >= rise[:-2]) & (mid >= rise[2:])).sum() / seconds)
    if len(x) > 1:
        out["zcr"] = float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return out


def features(waves: DataFrame, key: str) -> DataFrame:
    """key, the 16 measures and error of waves (key, rate, signal, error); what can't be measured has its error."""
    out = T.StructType([waves.schema[key], *[T.StructField(m, T.DoubleType()) for m in MEASURES], T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, rate, signal, error in zip(batch[key], batch["rate"], batch["signal"], batch["error"], strict=True):
                if error is None and (signal is None or not len(signal)):
                    error = "decoded audio is empty"
                rows.append({key: k, "error": error} | (measure(signal, int(rate)) if error is None else {}))
            yield pd.DataFrame(rows, columns=out.names)

    return waves.select(key, "rate", "signal", "error").mapInPandas(run, out)


#: Samples of a block of a long signal, and of the frames whose spectra stand for its own.
BLOCK, WINDOW = 1 << 18, 1 << 16
LEVELS = "rate int, block long, n long, peak double, squares double, crossings long, head boolean, tail boolean, energies array<double>, spectral array<double>"
PLACES = ("first", "last", "top", "risen")


def _levels(x: np.ndarray, rate: int, window: int) -> tuple:
    """What of a block adds up: peak, energy, crossings, energies of its half frames, and sums over the bins of its frames:
    amplitude, frequency times amplitude, bins, log power, power, and power by band."""
    sign = np.signbit(x)
    halves = np.square(x[: len(x) // HOP * HOP].astype(np.float64)).reshape(-1, HOP).sum(axis=1)
    sums = np.zeros(5 + len(BANDS))
    hz, shape = np.fft.rfftfreq(window, 1.0 / rate), np.hanning(window)
    for a in range(0, len(x), window):
        frame = x[a : a + window].astype(np.float64)
        spectrum = np.abs(np.fft.rfft(np.pad(frame, (0, window - len(frame))) * shape))
        power = np.square(spectrum)
        bands = [power[(hz >= low) & (hz < (rate / 2 + 1 if high is None else high))].sum() for low, high in BANDS.values()]
        sums += [spectrum.sum(), (hz * spectrum).sum(), len(hz), np.log(power + EPS).sum(), power.sum(), *bands]
    return float(np.abs(x).max()), float(np.square(x.astype(np.float64)).sum()), int((sign[1:] != sign[:-1]).sum()), bool(sign[0]), bool(sign[-1]), halves.tolist(), sums.tolist()


def _finish(r: dict) -> dict[str, float]:
    """The measures from what the blocks of a signal add up to; its ``parts`` are in order."""
    out, n, peak = dict.fromkeys(MEASURES, 0.0), r["n"], r["peak"]
    rms, ms, seconds = float(np.sqrt(r["squares"] / n)), 1000.0 / r["rate"], n / r["rate"]
    out |= {"duration_s": seconds, "peak": peak, "rms": rms, "crest": peak / rms if rms > EPS else 0.0}
    if peak > EPS:
        out |= {"attack_ms": (r["risen"] - r["first"]) * ms, "tail_ms": (r["last"] - r["top"]) * ms, "head_silence_ms": r["first"] * ms, "tail_silence_ms": (n - 1 - r["last"]) * ms}
    amplitude, weighted, bins, logs, power, *bands = np.sum([p["spectral"] for p in r["parts"]], axis=0).tolist()
    if power > EPS and amplitude > EPS:
        out |= {"centroid_hz": weighted / amplitude, "flatness": float(np.exp(logs / bins) / (power / bins + EPS))} | {b: x / power for b, x in zip(BANDS, bands, strict=True)}
    energy = np.concatenate([p["energies"] for p in r["parts"]])
    if len(energy) > 1:
        rise = np.maximum(0.0, np.diff(np.sqrt((energy[1:] + energy[:-1]) / FRAME).astype(np.float32)))
        if len(rise) >= 2 and rise.max() > EPS:
            mid = rise[1:-1]
            out["onset_density"] = float(((mid > rise.mean() + rise.std()) & (mid >= rise[:-2]) & (mid >= rise[2:])).sum() / seconds)
    if n > 1:
        edges = sum(a["tail"] != b["head"] for a, b in zip(r["parts"], r["parts"][1:], strict=False))
        out["zcr"] = (r["crossings"] + edges) / (n - 1)
    return out


def block_features(blocks: DataFrame, key: str, size: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """key and the 16 measures of signals that come in blocks (key, rate, block, samples), block from 0, all but the last of
    ``size`` samples, a multiple of ``window`` and of half a frame.

    No task holds more than a block: levels, energies and spectra of blocks are added up, and a second pass finds the
    places at which a signal passes shares of its peak. Of a whole signal only the energies of its half frames, a number
    in 512 samples, come together. Spectral measures are those of all bins of the Hann frames of ``window`` samples,
    so that they stand for the signal in time; a signal of one block that isn't full is measured by one
    transform, as ``measure`` does.
    """
    if size % window or size % HOP:
        raise ValueError("a block must hold whole frames")
    short = (F.col("block") == 0) & (F.size("samples") < size)
    one = features(blocks.filter(short).select(key, "rate", F.col("samples").alias("signal"), F.lit(None).cast("string").alias("error")), key).drop("error")
    many = blocks.filter(~short).filter(F.size("samples") > 0).select(key, "rate", "block", "samples")
    kind, places = many.schema[key], ", ".join(f"_{p} long" for p in PLACES)
    named = f"{key} {kind.dataType.simpleString()}"

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, rate, block, samples in zip(batch[key], batch["rate"], batch["block"], batch["samples"], strict=True):
                rows.append((k, rate, block, len(samples), *_levels(np.nan_to_num(np.asarray(samples, np.float32)), int(rate), window)))
            yield pd.DataFrame(rows, columns=[key, "rate", "block", "n", "peak", "squares", "crossings", "head", "tail", "energies", "spectral"])

    def where(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, block, samples, peak in zip(batch[key], batch["block"], batch["samples"], batch["_peak"], strict=True):
                level, at = np.abs(np.nan_to_num(np.asarray(samples, np.float32))), int(block) * size
                loud, high, top = (np.flatnonzero(level >= x) for x in (max(peak * ACTIVE, EPS), peak * RISEN, peak))
                found = [(x[i] + at if len(x) else None) for x, i in ((loud, 0), (loud, -1), (top, 0), (high, 0))]
                rows.append((k, *found))
            yield pd.DataFrame(rows, columns=[key, *[f"_{p}" for p in PLACES]]).astype({f"_{p}": "Int64" for p in PLACES})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{key: r[key]} | _finish(r) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[key, *MEASURES])

    part = staged(many.mapInPandas(levels, f"{named}, {LEVELS}"), "levels")
    whole = part.groupBy(key).agg(F.max("rate").alias("rate"), F.sum("n").alias("n"), F.max("peak").alias("peak"), F.sum("squares").alias("squares"), F.sum("crossings").alias("crossings"), F.sort_array(F.collect_list(F.struct("block", "head", "tail", "energies", "spectral"))).alias("parts"))
    peaks = part.groupBy(F.col(key).alias("_key")).agg(F.max("peak").alias("_peak"))
    found = many.join(peaks, F.col(key).eqNullSafe(F.col("_key"))).select(key, "block", "samples", "_peak").mapInPandas(where, f"{named}, {places}")
    at = found.groupBy(F.col(key).alias("_key")).agg(F.min("_first").alias("first"), F.max("_last").alias("last"), F.min("_top").alias("top"), F.min("_risen").alias("risen"))
    both = whole.join(at, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return one.unionByName(both.mapInPandas(finish, one.schema))


def cached(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items (path, size, mtime) with the cache's other columns where size and time agree and no error is noted."""
    good = cache.filter(F.coalesce("error", F.lit("")) == "").drop("error")
    return items.join(good, ["path", "size", "mtime"])


def sync(items: DataFrame, done: DataFrame, legacy: DataFrame, waves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New feature rows (sample_id, payload, error) and the job's counters (status, n).

    Samples (sample_id, path, size, mtime_ms, name) that are done are skipped; others take the payload that
    the legacy cache (size, mtime_ms, name, payload) has of them without doubt; the rest is measured from ``waves`` (path, rate,
    signal, error), failures being data. A sample of several paths counts once.
    """
    one = items.groupBy("sample_id").agg(F.min_by(F.struct("path", "size", "mtime_ms", "name"), "path").alias("x")).select("sample_id", "x.*")
    todo = one.join(done.select("sample_id"), "sample_id", "left_anti")
    found = catalog.cascading(todo, legacy)
    moved = found.filter("status <> 'measure'").select("sample_id", "payload", F.lit(None).cast("string").alias("error"), F.lit("migrated").alias("status"))
    rest = found.filter("status = 'measure'").select("sample_id", "path")
    got = features(rest.join(waves, "path").select("sample_id", "rate", "signal", "error"), "sample_id")
    payload = F.when(F.col("error").isNull(), F.to_json(F.struct(*MEASURES))).otherwise("{}")
    new = got.select("sample_id", payload.alias("payload"), "error", F.when(F.col("error").isNull(), "extracted").otherwise("failed").alias("status"))
    lost = rest.join(waves.select("path").distinct(), "path", "left_anti").select("sample_id", F.lit("{}").alias("payload"), F.lit("no such file").alias("error"), F.lit("failed").alias("status"))
    every = moved.unionByName(new).unionByName(lost)
    skipped = one.join(done.select("sample_id").distinct(), "sample_id", "left_semi").select(F.lit("skipped").alias("status"))
    counters = every.select("status").unionByName(skipped).groupBy("status").agg(F.count("*").alias("n"))
    return every.drop("status"), counters
