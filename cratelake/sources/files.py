"""Readers and writers of libraries, sheets and manifests."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import wave
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratelake.functions import paths

#: What a scan takes and passes over.
AUDIO = ("wav", "aif", "aiff", "flac", "mp3", "ogg")
STAGING = ("_EXPORT", "_TO-DELETE", "_QUARANTINE")
#: Bytes that are read at once.
PIECE = 1 << 23


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _relative(root: str):
    return F.regexp_extract("path", "/" + root.strip("/").replace(".", r"\.") + "/(.*)$", 1)


def scan_library(spark: SparkSession, root: str, uri: str | None = None) -> DataFrame:
    """path (relative), length and modificationTime of the audio files below a root, and the whole path as ``uri``; staging
    zones, hidden and shadow folders are passed over. Contents aren't read."""
    files = _files(spark, root).select(_relative(root).alias("path"), "length", "modificationTime", *[F.col("path").alias(c) for c in [uri] if c])
    p = paths.parts(F.col("path"))
    hidden = F.exists(p, lambda x: x.startswith(".") | (x == "__MACOSX"))
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*AUDIO) & ~F.get(p, F.lit(0)).isin(*STAGING) & ~hidden)


def open_stream(uri: str, seek: bool = False):
    """A file as a stream of bytes, of any store that Arrow reads: local disks, HDFS, S3, GCS."""
    scheme, host, path = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", uri, re.DOTALL).groups()
    if scheme == "file":
        store, base = pafs.LocalFileSystem(), ""
    else:
        store, base = pafs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
    full = base.rstrip("/") + path
    return store.open_input_file(full) if seek else store.open_input_stream(full)


def hash_files(listed: DataFrame, uri: str, out: str, opened: Accumulator | None = None) -> DataFrame:
    """Adds ``out``, the SHA-256 of each listed file's bytes. Tasks open the files themselves and read them in pieces, so
    that a file may be of any length and no other is touched; ``opened`` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for u in batch.column(uri).to_pylist():
                digest = hashlib.sha256()
                with open_stream(u) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                if opened is not None:
                    opened.add(1)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, out])

    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.repartition(parts, uri)  # a list is short, so that Spark would read it in one task
    return dealt.mapInArrow(run, T.StructType([*listed.schema.fields, T.StructField(out, T.StringType())]))


def content_ids(spark: SparkSession, root: str, cache: DataFrame, opened: Accumulator | None = None) -> DataFrame:
    """The scan with sample_id: cached (path, length, modificationTime, sample_id) rows keep theirs,
    only the others' bytes are read and hashed. ``opened`` counts the files that are."""
    keys = ["path", "length", "modificationTime"]
    seen = scan_library(spark, root, uri="_uri")
    once = cache.groupBy(*keys).agg(F.min("sample_id").alias("sample_id"))
    known = seen.drop("_uri").join(once, keys)
    new = seen.join(once.select(*keys), keys, "left_anti")
    return known.unionByName(hash_files(new, "_uri", "sample_id", opened).drop("_uri"))


def read_sheet(spark: SparkSession, path: str, columns: tuple[str, ...], *, exact: bool = True) -> DataFrame:
    """A tab-separated sheet as trimmed strings. With ``exact`` its header must be these columns in
    order, else it must hold them all; the header is checked when the reader is made."""
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    if exact and tuple(raw.columns) != tuple(columns):
        raise ValueError(f"expected the columns {list(columns)}, found {raw.columns}")
    if missing := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"missing columns {missing}")
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in raw.columns])


def read_features(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A feature sheet: rows with an error, or with a required number missing or unreadable, go."""
    sheet = read_sheet(spark, path, ("path", "audio_error", *required), exact=False)
    numbers = sheet.filter("audio_error = ''").withColumns({c: F.col(c).try_cast("double") for c in required})
    return numbers.na.drop(subset=list(required))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A feature sheet by the names of its columns: path, centroid_hz, sub_ratio, duration_s; blanks and what isn't a number
    are null, a sheet without paths is an error."""
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    if "path" not in raw.columns:
        raise ValueError("features sheet lacks the column path")
    number = lambda c: (F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(c)
    return raw.select("path", *[number(c) for c in ("centroid_hz", "sub_ratio", "duration_s")])


def read_labels(spark: SparkSession, pattern: str) -> DataFrame:
    """The label sheets of all roles, with the file of each row."""
    sheet = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(pattern)
    return sheet.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in sheet.columns], F.col("_metadata.file_path").alias("file"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, lines numbered from 1 in its order; a manifest is written by hand and read whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def read_rules(path: str) -> list:
    """Tag rules of a TOML file: schema version 1, a name and a group each, none twice, comparisons as ``>=0.60``."""
    import tomllib

    from cratelake.operators.tags import Rule

    with open(path, "rb") as f:
        table = tomllib.load(f)
    if table.get("schema_version") != 1:
        raise ValueError(f"unsupported schema version in {path}")
    rules = {}
    for raw in table.get("tag", []):
        key = tuple(str(raw.get(k, "")).strip().lower() for k in ("group", "name"))
        if not all(key) or key in rules:
            raise ValueError(f"a tag needs a group and a name of its own: {raw}")
        tests = []
        for column, text in dict(raw.get("features") or {}).items():
            if not (m := re.fullmatch(r"\s*(>=|<=|==|>|<)\s*(-?\d+(?:\.\d+)?)\s*", str(text))):
                raise ValueError(f"{key[0]}/{key[1]}: can't read the test {column} {text!r}")
            tests.append((column, m[1], float(m[2])))
        words = {k: tuple(str(x).lower() for x in raw.get(k) or ()) for k in ("origins", "origin_matches", "name_matches")}
        rules[key] = Rule(key[1], key[0], roles=tuple(raw.get("roles") or ()), features=tuple(tests), **words)
    return list(rules.values())


PROJECT = "path string, tempo double, tracks array<string>, scene_count int, scenes array<string>, devices array<string>, chains array<struct<track: string, kind: string, depth: int, devices: array<string>>>, error string"
PROJECT_COLUMNS = ("path", "tempo", "tracks", "scene_count", "scenes", "devices", "chains", "error")
#: The tags of tracks that a summary doesn't name: it names those that hold clips.
UNNAMED = ("GroupTrack", "ReturnTrack", "MasterTrack", "MainTrack", "PreHearTrack")


def _project(stream) -> tuple:
    """tempo, tracks, scene_count, scenes, devices and chains of a project's XML, which is read as a stream of events:
    elements are dropped as they end, so that memory grows with what is found, not with the file."""
    tempo, scenes, devices, found, open_, path = None, [], [], [], [], []
    for event, e in ET.iterparse(stream, events=("start", "end")):
        if event == "start":
            parent = path[-1] if path else None
            path.append(e.tag)
            if e.tag.endswith("Track") or parent == "Tracks":
                open_.append({"track": None, "kind": e.tag, "depth": len(open_), "devices": []})
                found.append(open_[-1])
            elif e.tag == "Manual" and parent == "Tempo" and tempo is None:
                tempo = float(e.get("Value"))
            elif e.tag == "EffectiveName" and parent == "Name" and open_ and open_[-1]["track"] is None:
                open_[-1]["track"] = e.get("Value")
            elif e.tag == "Scene" and parent == "Scenes":
                scenes.append(e.get("Name"))
            elif e.tag == "Name" and parent == "Scene" and scenes and scenes[-1] is None:
                scenes[-1] = e.get("Value")
            if parent == "Devices":
                devices.append(e.tag)
                if open_:
                    open_[-1]["devices"].append(e.tag)
        else:
            path.pop()
            if e.tag.endswith("Track") or path and path[-1] == "Tracks":
                open_.pop()
            e.clear()
    tracks = [t["track"] for t in found if t["kind"] not in UNNAMED and t["track"]]
    return tempo, tracks, len(scenes), [s or "" for s in scenes], devices, found


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """One row a gzip XML project file: tempo; the names of its MIDI and audio tracks in the order of the file, nested ones too;
    scenes, their names (blank for none) and number; devices; and chains, a row for each track of any kind with how deep it
    is nested and the devices of its own. A file that can't be read has only its error. Backup folders and dot files are
    passed over."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with gzip.open(io.BytesIO(content)) as stream:
                        rows.append((path, *_project(stream), None))
                except (OSError, EOFError, ValueError, zlib.error, ET.ParseError) as e:
                    rows.append((path, *[None] * 6, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=PROJECT_COLUMNS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.als").load(root)
    return files.filter(~F.col("path").rlike(r"/Backup/|/\.[^/]*$")).select("path", "content").mapInPandas(parse, PROJECT)


def project_index(projects: DataFrame) -> DataFrame:
    """The sheet of the readable projects: path, tempo, track_count, tracks, scene_count, devices, lists joined by commas."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return projects.filter("error IS NULL").select("path", F.coalesce(F.col("tempo").cast("string"), F.lit("")).alias("tempo"), F.size("tracks").alias("track_count"), joined("tracks"), "scene_count", joined("devices"))


def project_devices(projects: DataFrame) -> DataFrame:
    """(path, place, track, kind, depth, position, device): the devices of each track, in the order of the file."""
    chains = projects.filter("error IS NULL").select("path", F.posexplode("chains").alias("place", "_c"))
    return chains.select("path", "place", "_c.track", "_c.kind", "_c.depth", F.posexplode("_c.devices").alias("position", "device"))


WAVE = T.StructType().add("path", "string").add("rate", "integer").add("signal", T.ArrayType(T.FloatType())).add("error", "string")


def read_waves(spark: SparkSession, root: str, rate: int = 22050) -> DataFrame:
    """PCM wave files (16 bit) as mono signals at one rate; other codecs have only their error."""

    def decode(batches):

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error("not 16 bit")
                        own, mono = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
                    at = np.arange(round(len(mono) * rate / own)) * own / rate
                    rows.append((path, rate, np.interp(at, np.arange(len(mono)), mono).astype("float32") if len(mono) else [], None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=WAVE.names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    return files.select("path", "content").mapInPandas(decode, WAVE)


def read_wave_blocks(spark: SparkSession, root: str, rate: int = 22050, size: int = 1 << 18) -> DataFrame:
    """(path, rate, block, samples, error): the waves of ``read_waves`` in blocks of ``size`` samples, all but the last of a
    file full. Headers are read first; then each block is a row of its own, whose task seeks to it in the file, so
    that one long file is read by many tasks and none holds more than a block."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with open_stream(path, seek=True) as f, wave.open(f) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error("not 16 bit")
                        rows.append((path, round(w.getnframes() * rate / w.getframerate()), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "n", "error"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, n, error, block in zip(batch["path"], batch["n"], batch["error"], batch["block"], strict=True):
                samples = None
                if error is None and n:
                    with open_stream(path, seek=True) as f, wave.open(f) as w:
                        at = np.arange(block * size, min(n, (block + 1) * size)) * w.getframerate() / rate
                        low, high = int(at[0]), min(w.getnframes(), int(at[-1]) + 2)
                        w.setpos(low)
                        mono = np.frombuffer(w.readframes(high - low), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
                        samples = np.interp(at - low, np.arange(len(mono)), mono).astype("float32")
                yield pd.DataFrame({"path": [path], "rate": [rate], "block": [block], "samples": [samples], "error": [error]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = files.repartition(parts, "path").mapInPandas(heads, "path string, n long, error string")
    last = F.greatest(F.floor((F.col("n") - 1) / size), F.lit(0))
    blocks = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(parts, "path", "block")
    return blocks.mapInPandas(cut, "path string, rate int, block long, samples array<float>, error string")


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder a value of a column, as the review indexes by role or tempo."""
    df.repartition(by, F.abs(F.xxhash64("path")) % 8).write.mode("overwrite").partitionBy(by).parquet(path)


def write_review(df: DataFrame, path: str) -> None:
    """The split indexes of a review: by role where the role is sure, by tempo band, and what needs a look."""
    write_split(df.filter("confidence = 'high'").withColumnRenamed("source", "path"), f"{path}/by-role", "role")
    write_split(df.withColumnRenamed("source", "path"), f"{path}/by-tempo", "tempo_fit")
    df.filter("role = '_REVIEW' OR confidence = 'low'").write.mode("overwrite").parquet(f"{path}/review-needed")


def write_crates(df: DataFrame, path: str) -> None:
    """Crate rows, a folder a crate, in the order of their places."""
    df.repartition("crate").sortWithinPartitions("crate", "place").write.mode("overwrite").partitionBy("crate").option("sep", "\t").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").csv(path)


def write_playlist(df: DataFrame, path: str, root: str, seq: str) -> None:
    """One absolute path a line, in the order of a column. Files are written in that order too, so
    reading them by name keeps it."""
    df.orderBy(seq).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("value")).write.mode("overwrite").text(path)


def digest(df: DataFrame) -> DataFrame:
    """A table's count and order-independent digest, to tell whether a frozen sheet still agrees."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))
