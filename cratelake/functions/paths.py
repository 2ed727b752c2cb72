"""Columns over asset paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def zone(path: Column) -> Column:
    first = F.get(parts(path), F.lit(0))
    return F.when((F.size(parts(path)) > 1) & first.isin("PACKS", "CATALOGUE", "CURATED"), first).otherwise("ROOT")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(parts(path), -1), r"(?<=.)\.[^.]*$", "")


def short_id(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def source_group(path: Column) -> Column:
    return F.when(F.size(parts(path)) > 3, F.get(parts(path), F.lit(2))).otherwise("_root")


def content_path(path: Column) -> Column:
    """A curated path without its zone and role; any other as it is."""
    p = parts(path)
    return F.when((zone(path) == "CURATED") & (F.size(p) > 2), F.array_join(F.slice(p, F.lit(3), F.size(p)), "/")).otherwise(path)


def source_token(path: Column) -> Column:
    """What follows the first ``_`` of a generated (lower-case) name, without a collision number;
    null for loops, which begin with a tempo or a key."""
    return source_token_raw(F.regexp_replace(stem(path), "-[0-9]+$", ""))


def source_token_raw(s: Column) -> Column:
    """The same of a stem whose collision number, if any, stays."""
    loop = F.substring_index(s, "_", 1).rlike("^([0-9]{2,3}|[a-g][sb]?m?)$")
    return F.when((s == F.lower(s)) & ~loop, F.nullif(F.regexp_extract(s, "^[^_]*_(.*)$", 1), F.lit("")))


def parts_text(path: Column) -> Column:
    return F.replace(F.translate(F.lower(path), "_.", "  "), F.lit("/"), F.lit(" / "))


def tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(parts_text(path), "[^a-z0-9#b]+"), lambda t: t != ""))


def normalise_token(value: Column) -> Column:
    s = F.replace(F.replace(F.lower(F.trim(value)), F.lit("'"), F.lit("")), F.lit("&"), F.lit("and"))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9._-]+", "-"), "-{2,}", "-"), "_{2,}", "_")
    return F.coalesce(F.nullif(F.btrim(s, F.lit("-_")), F.lit("")), F.lit("sample"))


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def loop_word(path: Column) -> Column:
    return parts_text(path).contains("loop") | parts_text(path).contains("groove")


def bpm(path: Column) -> Column:
    """``NNN bpm``, else ``[NNN]``, else in a loop a bare number from 60 to 200."""
    bare = F.when(loop_word(path), _group(path, r"(?i)(?<![a-z0-9])([6-9][0-9]|1[0-9][0-9]|200)(?![a-z0-9])"))
    return F.coalesce(_group(path, r"(?i)(?<![0-9])([0-9]{2,3})\s*bpm(?![0-9])"), _group(path, r"\[([0-9]{2,3})\]"), bare)


def tempo_fit(value: Column) -> Column:
    n = value.cast("int")
    return F.when(n.isNull(), "unknown").when(n.between(130, 150), "techno-core").when(n.between(124, 129), "techno-adjacent").when(n < 124, "house-lower").otherwise("too-fast")


def ratio_distance(a: Column, b: Column, floor: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))
