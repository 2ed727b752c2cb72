"""Project sets of a library and the registry of its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelake.functions import analysis, names, paths
from cratelake.operators import catalog


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _by_parts(path: Column) -> Column:
    """Orders paths by their parts."""
    return F.replace(path, F.lit("/"), F.lit("\x01"))


def registry(files: DataFrame) -> DataFrame:
    """set_root, set_name, audio_root, projects, patterns, audio, doc of each set below a library's files (path).

    A set is a folder with a ``project.work``, or the folder above it if the audio folder lies there. Its
    files are found by joining every file's ancestors with the roots.
    """
    p = F.col("path")
    seen = files.filter(~analysis.hidden(p)).select("path").distinct()
    folders = catalog.ancestors(seen.filter(p.contains("/")), "path", "folder").select("path", "folder")
    audio_folder = folders.filter(F.element_at(paths.parts(F.col("folder")), -1) == "AUDIO").select("folder").distinct()
    held = lambda name: audio_folder.select(F.col("folder").alias(name), F.lit(True).alias("has" + name))
    control = seen.filter((F.element_at(paths.parts(p), -1) == "project.work") & ~analysis.staging(p)).select(_parent(p).alias("control"))
    under = lambda folder: F.when(folder == "", "AUDIO").otherwise(F.concat(folder, F.lit("/AUDIO")))
    roots = control.withColumn("_own", under(F.col("control"))).withColumn("_up", under(_parent(F.col("control"))))
    roots = roots.join(held("_own"), "_own", "left").join(held("_up"), "_up", "left")
    root = F.when(F.col("has_own"), F.col("control")).when(F.col("has_up"), _parent(F.col("control"))).otherwise(F.col("control"))
    roots = roots.select(root.alias("set_root"), "control").groupBy("set_root").agg(F.max("control").alias("control"))
    roots = roots.select("set_root", F.element_at(paths.parts(F.col("control")), -1).alias("set_name"), under(F.col("set_root")).alias("audio_root"), _parent(F.col("set_root")).alias("_above"))
    ext = analysis.suffix(p)
    inside = folders.join(roots.select("set_root", "audio_root"), F.col("folder") == F.col("set_root"))
    in_audio = ext.isin(*analysis.AUDIO_EXTS) & F.startswith(p, F.concat("audio_root", F.lit("/")))
    counts = inside.groupBy("set_root").agg(F.count_if(ext == ".work").alias("projects"), F.count_if(ext == ".strd").alias("patterns"), F.count_if(in_audio).alias("audio"))
    docs = folders.filter(ext.isin(*analysis.DOC_EXTS)).unionByName(seen.filter(ext.isin(*analysis.DOC_EXTS)).withColumn("folder", F.lit("")))
    near = roots.select("set_root", F.explode(F.array_distinct(F.array("set_root", "_above"))).alias("folder"))
    first = docs.join(near, "folder").groupBy("set_root").agg(F.min_by("path", _by_parts(p)).alias("doc"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return roots.drop("_above").join(counts, "set_root", "left").join(first, "set_root", "left").select("set_root", "set_name", "audio_root", z("projects"), z("patterns"), z("audio"), "doc")


def containing(files: DataFrame, sets: DataFrame) -> DataFrame:
    """Files (path) with the first set, in the order of roots, that holds them; nulls for none."""
    up = catalog.ancestors(files.select("path").distinct().filter(F.contains("path", F.lit("/"))), "path", "set_root")
    hit = up.join(sets.select("set_root", "audio_root"), "set_root").groupBy("path").agg(F.min_by(F.struct("set_root", "audio_root"), _by_parts(F.col("set_root"))).alias("_s"))
    return files.join(hit, "path", "left").select(*files.columns, F.col("_s.set_root").alias("set_root"), F.col("_s.audio_root").alias("audio_root"))


def sources(files: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """path, source_kind, source_name, processing_tag, processing_reason of every catalogued file (path)."""
    p = F.col("path")
    held = containing(files.select("path"), registry(files) if sets is None else sets).withColumn("source_kind", analysis.source_kind(p, F.col("set_root"), F.col("audio_root")))
    return held.filter("source_kind IS NOT NULL").select("path", "source_kind", analysis.source_name(p).alias("source_name"), names.processing_tag(p).alias("processing_tag"), analysis.processing_reason(p).alias("processing_reason"))
