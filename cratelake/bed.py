"""Views that put the driver's tables in the shape of an asset library, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = ("PACKS", "CATALOGUE", "CURATED")
WORDS = (
    "kick", "open hat", "top loop 128 bpm", "cowbell", "snare_rim", "deep bass", "sub loop 96 bpm", "stab chord", "dark drone", "riser fx", "vox hit", "Conga 04",
    "clap tight", "closed hat", "ride", "shaker groove 132", "piano Amin", "texture wide", "noise sweep", "Break [140]", "tom low", "chh short", "unknown thing", "guiro",
)
EXTS = ("wav", "aif", "flac", "mp3", "ogg")


def _pick(values: tuple, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    name = F.concat(_pick(WORDS, i % 24), F.lit("-"), i.cast("string"), F.lit("_"), F.col("source"), F.lit("."), _pick(EXTS, i % 5))
    return d.select("doc_id", F.sha2(F.col("text"), 256).alias("sample_id"), F.col("n_chars").alias("size"), _pick(WORDS, i % 24).alias("word"), F.concat_ws("/", _pick(ZONES, i % 3), "source", "lang", name).alias("path"))


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


LOC = f"""loc AS (SELECT doc_id, sha256(text) AS sample_id, n_chars AS size, {_list(WORDS)}[doc_id % 24 + 1] AS word,
  {_list(ZONES)}[doc_id % 3 + 1] || '/' || source || '/' || lang || '/' || {_list(WORDS)}[doc_id % 24 + 1] || '-' || doc_id || '_' || source || '.' || {_list(EXTS)}[doc_id % 5 + 1] AS path
  FROM documents)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double"))
    v = F.transform(v, lambda x, i: F.when((i == 3) & (F.col("vec_id") % 7 == 0), F.lit(None)).otherwise(x))
    return e.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("R"), (F.col("label") % 4).cast("string")).alias("role"), v.alias("v"))


FEAT = """feat AS (SELECT vec_id AS sample_id, 'R' || (label % 4) AS role,
  list_transform(range(1, 17), lambda i: CASE WHEN i = 4 AND vec_id % 7 = 0 THEN NULL ELSE embedding[i]::DOUBLE END) AS v FROM embeddings)"""


FOLDERS = ("KICKS", "CLAP-SNARE", "HATS-CYM", "PERC", "DRUM-LOOPS", "BASS", "SYNTH-STAB-CHORD", "DRONE-ATMOS", "FX-RISE-IMPACT", "VOCALS")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a library (path): packs, curated files, stray folders, sets with audio, projects and documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i, word, ext = F.col("doc_id"), _pick(WORDS, F.col("doc_id") % 24), _pick(EXTS, F.col("doc_id") % 5)
    num, at = i.cast("string"), F.concat(F.lit("Set "), (i % 7).cast("string"))
    of = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    loose = F.when(i % 3 == 0, of(at, "/project.work")).when(i % 3 == 1, of(at, "/notes ", (i % 2).cast("string"), ".txt")).otherwise(of(at, "/bank", num, ".strd"))
    path = (
        F.when(i % 5 == 0, of("PACKS/", F.col("source"), "/", F.col("lang"), "/", word, "-", num, ".", ext))
        .when(i % 5 == 1, of("CURATED/", _pick(FOLDERS, i % 10), "/", word, "-", num, "_", F.col("source"), ".", _pick(EXTS, i % 3)))
        .when(i % 5 == 2, of(F.col("source"), " WAV/", word, ".", _pick(EXTS, i % 3))).when(i % 5 == 3, of(at, "/AUDIO/", word, "-", num, ".wav")).otherwise(loose)
    )
    return d.select(path.alias("path")).distinct()


LIB = f"""lib AS (SELECT DISTINCT CASE doc_id % 5
  WHEN 0 THEN 'PACKS/' || source || '/' || lang || '/' || {_list(WORDS)}[doc_id % 24 + 1] || '-' || doc_id || '.wav'
  WHEN 1 THEN 'CURATED/' || {_list(FOLDERS)}[doc_id % 10 + 1] || '/' || {_list(WORDS)}[doc_id % 24 + 1] || '-' || doc_id || '_' || source || '.' || ['wav', 'aif', 'flac'][doc_id % 3 + 1]
  WHEN 2 THEN source || ' WAV/' || {_list(WORDS)}[doc_id % 24 + 1] || '.' || ['wav', 'aif', 'flac'][doc_id % 3 + 1]
  WHEN 3 THEN 'Set ' || doc_id % 7 || '/AUDIO/' || {_list(WORDS)}[doc_id % 24 + 1] || '-' || doc_id || '.wav'
  ELSE CASE doc_id % 3 WHEN 0 THEN 'Set ' || doc_id % 7 || '/project.work' WHEN 1 THEN 'Set ' || doc_id % 7 || '/notes ' || doc_id % 2 || '.txt' ELSE 'Set ' || doc_id % 7 || '/bank' || doc_id || '.strd' END
  END AS path FROM documents)"""
