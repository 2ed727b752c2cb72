"""Plans of moves: unique names, reviews, sorting, intake, export, migration, and what a plan would do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelake.functions import analysis, names, paths
from cratelake.operators import catalog, gates, ladders
from cratelake.operators.select import numbered
from cratelake.staging import staged

# Where plans look and what they pass over.
REVIEW_SKIP = (*[r for r in analysis.ROLE_FOLDERS if r != "_REVIEW"], "CURATED", "MIDI", *analysis.STAGING)
KNOWN_TOP = (*analysis.ROLE_FOLDERS, *analysis.DEDUPE_EXCLUDE, "MIDI", "00_INBOX", "_PACKS", "CURATED", "PACKS")
NAME_WARN = 24
LONG_FORM = ("DRUM-LOOP", "BASS-LOOP", "SYNTH-LOOP", "VOCAL-LOOP", "TEXTURE-DRONE")
DEVICES = (("digitakt", "", True, 127, None), ("tr8s", "ROLAND/TR-8S/SAMPLE", True, 256, 600.0), ("octatrack", "EIDETIC-CURATED/AUDIO", False, None, None))


def _variant(dest: Column, n: Column, sep: str, whole: bool) -> Column:
    """dest, or from 2 on dest with the number before its extension (``whole``: at its end)."""
    number = F.concat(F.lit(sep), n.cast("string"))
    if whole:
        return F.when(n > 1, F.concat(dest, number)).otherwise(dest)
    cut = F.regexp_extract(dest, r"^(.*[^/])(\.[^./]*)$", 1)
    named = F.when(cut != "", F.concat(cut, number, F.regexp_extract(dest, r"(\.[^./]*)$", 1))).otherwise(F.concat(dest, number))
    return F.when(n > 1, named).otherwise(dest)


def _slots(names_: DataFrame, sep: str, whole: bool) -> DataFrame:
    """(dest, k), k from 2, of those names (_name) that are variants: whose, and with which number."""
    sep, number = re.escape(sep), "([1-9][0-9]{0,17})"
    found = F.col("_name")
    if not whole:
        found = F.regexp_replace(found, rf"^(.*[^/]){sep}{number}(\.[^./]*)$", "$1$3\x00$2")
    bare = "(.*)" if whole else r"((?:.*/)?\.?[^./]*)"
    found = F.regexp_replace(found, f"^{bare}{sep}{number}$", "$1\x00$2")
    cut = names_.select(F.split(found, "\x00").alias("_s")).filter(F.size("_s") == 2)
    return cut.select(F.get("_s", F.lit(0)).alias("dest"), F.get("_s", F.lit(1)).cast("long").alias("k")).filter("k > 1")


def unique_names(plan: DataFrame, dest: str, order: str, taken: DataFrame, sep: str = "-", whole: bool = False) -> DataFrame:
    """The plan with destinations that no other row and no row of ``taken`` (path) has.

    The rows of one destination get it, and then its variants from 2 on, in order. A number is passed over if its
    name is taken or is the destination of other rows, which are asked first. A name is the variant of
    one destination only, so no two rows can meet and one pass is enough.

    Free numbers come from an order, not from a list of all numbers: the j-th number that is gone, d, has d - j free
    ones before it, and sorting the n-th row after all those with d - j < n makes its place its
    number. Rows of one destination may be any share of the plan.
    """
    rows = staged(numbered(plan, [dest], [order], "_n"), "ranks")
    used = taken.select(F.col("path").alias("_name")).filter("_name IS NOT NULL").distinct()
    wanted = rows.select(F.col(dest).alias("_name")).distinct()
    gone = _slots(used.unionByName(wanted), sep, whole).unionByName(used.select(F.col("_name").alias("dest"), F.lit(1).cast("long").alias("k"))).distinct()
    gone = staged(gone.join(wanted.withColumnRenamed("_name", "dest"), "dest", "left_semi").select(F.col("dest").alias(dest), "k"), "gone")
    shared = gone.select(dest).distinct()
    late = numbered(gone, [dest], ["k"], "_j").select(dest, (F.col("k") - F.col("_j")).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_n"))
    early = rows.join(shared, dest, "left_semi").select(dest, F.col("_n").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("_n").cast("long").alias("_n"))
    placed = numbered(early.unionByName(late), [dest], ["_at", "_kind"], "_k").filter("_kind = 0").select(dest, "_n", "_k")
    number = F.coalesce("_k", "_n").cast("long")
    return rows.join(placed, [dest, "_n"], "left").select(*[_variant(F.col(dest), number, sep, whole).alias(c) if c == dest else F.col(c) for c in plan.columns])


def in_scope(path: Column, skip: tuple[str, ...]) -> Column:
    """Audio files below a top folder that isn't skipped, hidden ones apart."""
    p = paths.parts(path)
    top, name = F.get(p, F.lit(0)), F.element_at(p, -1)
    return (F.size(p) > 1) & ~top.isin(*skip) & ~top.startswith(".") & ~name.startswith(".") & analysis.suffix(path).isin(*analysis.AUDIO_EXTS)


def review(files: DataFrame, duration: str | None = None) -> DataFrame:
    """A row for each file (path) in scope: source, role, sample_type, bpm, key, tempo_fit, proposed_path,
    proposed_name, confidence, reason, warnings. The duration is asked for only where the path says nothing."""
    p = F.col("path")
    rows = files.filter(in_scope(p, REVIEW_SKIP)).withColumn("_r", ladders.role(p))
    seconds = None
    if duration:
        seconds = F.when(F.col("_r.role") == "_REVIEW", F.col(duration))
        rows = rows.withColumn("_d", seconds).withColumn("_r", F.when((F.col("_r.role") == "_REVIEW") & F.col("_d").isNotNull(), ladders.role(p, F.col("_d"))).otherwise(F.col("_r")))
        seconds = F.col("_d")
    role, bpm, name = F.col("_r.role"), F.coalesce(paths.bpm(p), F.lit("")), names.proposed_name(p, F.col("_r.role"))
    return rows.select(
        p.alias("source"), role.alias("role"), names.sample_type(p, role, seconds).alias("sample_type"), bpm.alias("bpm"), F.coalesce(names.musical_key(paths.stem(p)), F.lit("")).alias("key"),
        paths.tempo_fit(F.nullif(bpm, F.lit(""))).alias("tempo_fit"), F.concat_ws("/", role, names.source(p), name).alias("proposed_path"), name.alias("proposed_name"),
        F.col("_r.confidence").alias("confidence"), F.col("_r.reason").alias("reason"), F.when(F.length(name) > NAME_WARN, f"digitakt-name>{NAME_WARN}").otherwise("").alias("warnings"),
    )


def sort_plan(files: DataFrame, include_review: bool = False) -> DataFrame:
    """(src, dest, tag): every file in scope into its role's folder, under a name of its own."""
    r = staged(review(files), "review")
    r = r if include_review else r.filter(F.col("role") != "_REVIEW")
    folder = F.when(F.col("role") == "_REVIEW", F.col("role")).otherwise(F.concat(F.lit("CURATED/"), F.col("role")))
    plan = r.select(F.col("source").alias("src"), F.concat_ws("/", folder, "proposed_name").alias("dest"), F.concat_ws("|", "role", "reason").alias("tag"))
    return unique_names(plan, "dest", "src", files)


def bucket_plan(files: DataFrame, duration: str | None = None) -> DataFrame:
    """(src, dest, tag): every file in scope into a bucket by its words or, failing these, its duration."""
    p = F.col("path")
    rows = files.filter(in_scope(p, (*names.BUCKETS, *analysis.DEDUPE_EXCLUDE))).withColumn("_b", analysis.bucket(p, F.col(duration) if duration else None))
    return rows.select(p.alias("src"), names.bucket_path(p, F.col("_b.bucket")).alias("dest"), F.concat_ws("|", "_b.bucket", "_b.reason").alias("tag"))


def intake_plan(files: DataFrame) -> DataFrame:
    """(src, dest, tag): each stray top folder that holds audio into the packs, under a slug of its own."""
    p = paths.parts(F.col("path"))
    top = F.get(p, F.lit(0))
    stray = files.filter((F.size(p) > 1) & ~top.isin(*KNOWN_TOP) & ~top.startswith(".")).select(top.alias("src"), "path")
    audio = ~F.element_at(paths.parts(F.col("path")), -1).startswith(".") & analysis.suffix(F.col("path")).isin(*analysis.AUDIO_EXTS)
    packs = stray.select("src").distinct().join(stray.filter(audio).select("src").distinct(), "src", "left_semi")
    slug = F.coalesce(F.nullif(names.pack_slug(F.col("src")), F.lit("")), F.lit("pack"))
    plan = packs.select("src", F.concat(F.lit("PACKS/"), slug).alias("dest"), F.concat(F.lit("pack|"), F.col("src")).alias("tag"))
    there = files.select(F.concat_ws("/", top, F.get(p, F.lit(1))).alias("path")).filter("path LIKE 'PACKS/%'")
    return unique_names(plan, "dest", "src", there, whole=True)


def manifest(plan: DataFrame, day: Column) -> DataFrame:
    """Rows for the intake log: slug, original name, date."""
    return plan.select(F.element_at(paths.parts(F.col("dest")), -1).alias("slug"), F.substring_index("tag", "|", -1).alias("original"), day.alias("date"))


def preview(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan with the outcome of each row: missing (no source), exists (the destination is there), moved."""
    known = files.select("path").distinct()
    a, b = known.select(F.col("path").alias("src"), F.lit(True).alias("_src")), known.select(F.col("path").alias("dest"), F.lit(True).alias("_dest"))
    status = F.when(F.col("_src").isNull(), "missing").when(F.col("_dest").isNotNull(), "exists").otherwise("moved")
    return plan.join(a, "src", "left").join(b, "dest", "left").select(*plan.columns, status.alias("status"))


def undo(outcome: DataFrame) -> DataFrame:
    return outcome.filter("status = 'moved'").select(F.col("dest").alias("src"), F.col("src").alias("dest"))


def reclaimable(plan: DataFrame, files: DataFrame, src: str = "src") -> DataFrame:
    """One row: how many bytes the plan's sources hold."""
    return files.join(plan.select(F.col(src).alias("path")).distinct(), "path", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


# ---- patterns


def read_patterns(lines: DataFrame) -> DataFrame:
    """(line, pattern, rename) of manifest lines (line, value): comments and blanks go, ``pattern => name`` renames."""
    text = F.trim("value")
    rows = lines.filter((text != "") & ~text.startswith("#"))
    renamed = text.contains("=>")
    return rows.select("line", F.when(renamed, F.trim(F.substring_index(text, "=>", 1))).otherwise(text).alias("pattern"), F.when(renamed, F.nullif(F.trim(F.regexp_extract(text, "=>(.*)$", 1)), F.lit(""))).alias("rename"))


def _glob(pattern: Column) -> Column:
    """A glob as a regular expression over whole paths: ``**/`` any folders, ``*`` and ``?`` inside a part."""
    out = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    for old, new in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*"), ("[!", "[^")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit("^"), out, F.lit("$"))


#: Characters of the literal by which a glob without a folder of its own meets paths.
GRAM = 4
#: Into how many parts files are dealt for globs without any literal.
WILD = 16


def _glob_keys(globs: DataFrame) -> DataFrame:
    """Adds kind, key and size, by which a glob meets paths: ``dir``, the whole folders before its first wildcard;
    ``gram``, the first characters of its longest literal; ``wild``, nothing."""
    folder = F.regexp_extract("pattern", r"^([^*?\[]*)/", 1)
    runs = F.split(F.regexp_replace("pattern", r"\[[^\]]*\]|[*?]+/?", "\x00"), "\x00")
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    gram = F.substr(longest, F.lit(1), F.lit(GRAM))
    kind = F.when(folder != "", "dir").when(longest != "", "gram").otherwise("wild")
    return globs.withColumn("kind", kind).withColumn("key", F.when(folder != "", folder).otherwise(gram)).withColumn("size", F.length("key"))


def _fit_globs(globs: DataFrame, audio: DataFrame) -> DataFrame:
    """(line, pattern, rename, path) of files that fit a glob. Each glob has one key, each file each of its
    keys once, so that equality finds all pairs that the regular expression then decides, and none
    twice. Globs of wildcards only fit paths at large: they are dealt to every part of the files."""
    keyed = staged(_glob_keys(globs.withColumn("_re", _glob(F.col("pattern")))), "globs")
    sizes = [r["size"] for r in keyed.filter("kind = 'gram'").select("size").distinct().collect()]  # at most GRAM
    folders = catalog.ancestors(audio.filter(F.contains("path", F.lit("/"))), "path", "key").withColumn("kind", F.lit("dir"))

    def cuts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("path") - (n - 1), F.lit(1))), lambda i: F.substr("path", i, F.lit(n)))

    grams = audio.select("path", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(cuts, sizes)))).alias("key"), F.lit("gram").alias("kind"))
    met = folders.unionByName(grams).join(keyed.filter("kind <> 'wild'"), ["kind", "key"])
    parts = F.explode(F.sequence(F.lit(0), F.lit(WILD - 1))).alias("_part")
    wild = keyed.filter("kind = 'wild'").select("line", "pattern", "rename", "_re", parts)
    all_of = audio.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(WILD)).cast("int")).join(wild, "_part")
    cols = ["line", "pattern", "rename", "path", "_re"]
    return met.select(*cols).unionByName(all_of.select(*cols)).filter(F.expr("rlike(path, _re)")).drop("_re")


def match_patterns(patterns: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, pattern, rename, path) of audio files that are, lie below, or fit a pattern; and the patterns
    that match nothing. Names and folders meet on equality with a file's ancestors, globs by a
    literal part of theirs."""
    audio = files.select("path").filter(analysis.suffix(F.col("path")).isin(*analysis.AUDIO_EXTS)).distinct()
    glob = F.col("pattern").rlike(r"[*?\[]")
    under = catalog.ancestors(audio.filter(F.contains("path", F.lit("/"))), "path", "pattern").unionByName(audio.withColumn("pattern", F.col("path")))
    plain = patterns.filter(~glob).withColumn("pattern", F.rtrim(F.col("pattern"), F.lit("/"))).join(under, "pattern")
    found = plain.select("line", "pattern", "rename", "path").unionByName(_fit_globs(patterns.filter(glob), audio))
    return found, patterns.join(found.select("line").distinct(), "line", "left_anti")


def export_plan(patterns: DataFrame, files: DataFrame, limit: int = NAME_WARN) -> tuple[DataFrame, DataFrame]:
    """(line, src, out_name, warnings): files that patterns name, as ``.wav`` names of their own; and the
    patterns without a file. A single file takes the pattern's new name."""
    found, missing = match_patterns(patterns, files)
    alone = found.groupBy("line").agg((F.count("*") == 1).alias("_one"))
    base = F.when(F.col("_one") & F.col("rename").isNotNull(), F.col("rename")).otherwise(paths.stem(F.col("path")))
    rows = found.join(alone, "line").select("line", F.col("path").alias("src"), F.concat(paths.normalise_token(base), F.lit(".wav")).alias("out_name"), F.concat(F.lpad(F.col("line").cast("string"), 9, "0"), F.lit(" "), F.col("path")).alias("_order"))
    plan = unique_names(rows, "out_name", "_order", files.select(F.lit(None).cast("string").alias("path")).limit(0), sep="_")
    return plan.select("line", "src", "out_name", F.when(F.length("out_name") > limit, f"name >{limit} chars (will truncate on device)").otherwise("").alias("warnings")), missing


# ---- crates for devices


def devices(spark) -> DataFrame:
    """device, folder, one_shots (only such), max_rows, max_seconds."""
    return spark.createDataFrame(list(DEVICES), "device string, folder string, one_shots boolean, max_rows long, max_seconds double")


def bind_devices(bindings: DataFrame, specs: DataFrame) -> DataFrame:
    """A studio's devices (device, role, enabled) with their facts; unknown ones and those switched off go."""
    return bindings.filter(F.coalesce("enabled", F.lit(True))).join(F.broadcast(specs), "device")


def crate_plan(crate: DataFrame, name: str, locations: DataFrame, specs: DataFrame, device: str, must: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, source_path, out_name, out_path, keep_stereo) of a crate (row, sample_id, source_path, role, descriptor,
    reason) for a device, and its faults (row, violation; row null for the whole crate).

    Names number the rows of a role in the crate's order; ``locations`` is (path, sample_id, duration). With ``must`` the
    plan can't be read if there is a fault.
    """
    spec = specs.filter(F.col("device") == device)
    c = numbered(crate, ["role"], ["row"], "_i").withColumn("out_name", names.compact_name(F.col("role"), F.col("_i"), F.col("descriptor"), F.col("sample_id")))
    c = c.join(locations.select(F.col("path").alias("source_path"), F.col("sample_id").alias("_now"), "duration"), "source_path", "left").join(F.broadcast(spec))
    same = c.groupBy("out_name").agg(F.min("row").alias("_first"))
    c = c.join(same, "out_name", "left")
    bad = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.lit(text))
    rows = c.select("row", F.explode(F.array_compact(F.array(
        bad(F.col("out_name").isNull(), "unknown role"),
        bad(F.col("one_shots") & F.col("role").isin(*LONG_FORM), "one-shot roles only"),
        bad(F.col("_now").isNull(), "missing source"),
        bad(F.col("_now").isNotNull() & ~F.col("source_path").startswith("CURATED/"), "source outside CURATED"),
        bad(F.col("_now") != F.col("sample_id"), "hash changed"),
        bad(F.col("_first") < F.col("row"), "duplicate name"),
    ))).alias("violation"))
    totals = c.agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"), F.first("max_rows").alias("max_rows"), F.first("max_seconds").alias("max_seconds"))
    whole = totals.select(F.lit(None).cast("long").alias("row"), F.explode(F.array_compact(F.array(bad(F.col("n") > F.col("max_rows"), "too many rows"), bad(F.col("seconds") > F.col("max_seconds"), "too long")))).alias("violation"))
    crate_name = paths.normalise_token(F.lit(name))
    layout = F.when(F.col("device") == "tr8s", F.concat_ws("/", "folder", crate_name, "out_name")).otherwise(F.concat_ws("/", F.nullif("folder", F.lit("")), crate_name, "role", "out_name"))
    plan = c.select("row", "source_path", "out_name", layout.alias("out_path"), ((F.col("device") == "tr8s") & F.contains(F.coalesce("reason", F.lit("")), F.lit("stereo-essential"))).alias("keep_stereo"))
    faults = rows.select(F.col("row").cast("long").alias("row"), "violation").unionByName(whole)
    return gates.strict(plan, faults) if must else plan, faults


def crate_totals(crate: DataFrame, durations: DataFrame) -> DataFrame:
    return crate.join(durations, "source_path", "left").agg(F.count("*").alias("rows"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"))


# ---- projects


def references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (set_path, raw_path, relative_path) with resolved and present: an absolute path that exists, else
    the relative one from the project's folder."""
    known = files.select("path").distinct()
    parts = F.filter(F.split(F.concat_ws("/", F.regexp_replace("set_path", "/[^/]*$", ""), "relative_path"), "/"), lambda x: ~x.isin("", "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    rows = refs.withColumn("_raw", F.when(F.coalesce("raw_path", F.lit("")).startswith("/"), F.col("raw_path"))).withColumn("_rel", F.when(F.col("relative_path").isNotNull(), F.concat(F.lit("/"), F.array_join(fold, "/"))))
    a, b = known.select(F.col("path").alias("_raw"), F.lit(True).alias("_a")), known.select(F.col("path").alias("_rel"), F.lit(True).alias("_b"))
    rows = rows.join(a, "_raw", "left").join(b, "_rel", "left")
    resolved = F.when(F.col("_a"), F.col("_raw")).when(F.col("_b"), F.col("_rel")).otherwise(F.coalesce(F.nullif("raw_path", F.lit("")), "_rel"))
    return rows.select(*refs.columns, resolved.alias("resolved"), F.coalesce("_a", "_b", F.lit(False)).alias("present"))


def zone_references(projects: DataFrame, zone: str = "CURATED") -> DataFrame:
    """Projects (path, content) outside archives and backups whose text names a zone."""
    kept = ~F.exists(paths.parts(F.lower(F.col("path"))), lambda x: x.isin("archive", "backup"))
    return projects.filter(kept & F.contains("content", F.lit(zone))).select("path")


def migration(locations: DataFrame, moves: DataFrame, blockers: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dest, tag) of files below the moved prefixes (prefix, to, tag), and what stands in the way:
    projects that name the zone, destinations that exist, sources whose bytes changed since the scan.

    ``locations`` (path, sample_id) is the last complete scan, ``current`` (path, sample_id) the files as they are.
    """
    under = catalog.ancestors(locations.filter(F.contains("path", F.lit("/"))), "path", "prefix").unionByName(locations.withColumn("prefix", F.col("path")))
    plan = under.join(moves, "prefix").select(F.col("path").alias("src"), F.concat(F.col("to"), F.substr("path", F.length("prefix") + 1)).alias("dest"), "tag", "sample_id")
    now = current.select(F.col("path").alias("src"), F.col("sample_id").alias("_now"))
    stale = plan.join(now, "src", "left").filter(~F.col("_now").eqNullSafe(F.col("sample_id"))).select(F.col("src").alias("path"), F.lit("hash changed since the scan").alias("violation"))
    there = plan.join(current.select(F.col("path").alias("dest")), "dest", "left_semi").select(F.col("dest").alias("path"), F.lit("destination exists").alias("violation"))
    named = blockers.select("path", F.lit("a project names the zone").alias("violation"))
    return plan.drop("sample_id"), named.unionByName(there).unionByName(stale)


def require_complete(outcome: DataFrame) -> DataFrame:
    """The outcome of a migration; reading it fails if a row wasn't moved."""
    return outcome.withColumn("status", F.when(F.col("status") == "moved", F.col("status")).otherwise(F.raise_error(F.concat(F.lit("migration incomplete: "), F.col("src"), F.lit(" "), F.col("status")))))


