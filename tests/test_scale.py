"""Operators at sizes and skews at which a task for a key, or a plan evaluated twice, shows."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from cratelake.operators import plans, select


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", was)


def wide(spark, n):
    text = lambda k: F.sha2((F.col("id") * k).cast("string"), 256)
    return spark.range(n).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4 > 2).alias("key"), text(1).alias("s"), text(7).alias("x"), text(13).alias("y"))


def written(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "out"))
    return spark.read.parquet(str(tmp_path / "out"))


def gapless(got, out, *keys):
    for r in got.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(out).alias("d"), F.min(out).alias("lo"), F.max(out).alias("hi")).collect():
        assert r.n == r.d == r.hi and r.lo == 1


def test_numbers_of_wide_rows_written(spark, adaptive, tmp_path):
    got = written(spark, select.numbered(wide(spark, 20_000), ["key"], ["s"], "n"), tmp_path)
    assert got.count() == got.select("id").distinct().count() == 20_000 and got.select("key").distinct().count() == 3
    gapless(got, "n", "key")
    by_key = {}
    for r in got.orderBy("n").collect():
        by_key.setdefault(r.key, []).append(r.s)
    assert all(v == sorted(v) for v in by_key.values())


def test_global_places_of_wide_rows_written(spark, adaptive, tmp_path):
    got = written(spark, select.global_place(wide(spark, 20_000), [F.desc("s")], "n"), tmp_path)
    assert [r.s for r in got.orderBy("n").collect()] == sorted((r.s for r in wide(spark, 20_000).collect()), reverse=True)
    gapless(got, "n")


def test_two_million_wide_rows(spark, tmp_path):
    got = written(spark, select.numbered(wide(spark, 2_000_000), ["key"], ["s"], "n"), tmp_path)
    assert got.select("id").distinct().count() == 2_000_000
    gapless(got, "n", "key")


def test_numbers_of_an_empty_table(spark):
    assert select.numbered(wide(spark, 0), ["key"], ["s"], "n").count() == 0
    assert select.global_place(wide(spark, 0), ["s"], "n").count() == 0


def test_round_robin_without_a_limit_is_that_with_a_large_one(spark, tmp_path):
    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), F.lit(0).alias("all"))
    of = lambda limit: {(r.id, r.turn, r.place) for r in select.round_robin(rows, ["s"], ["g"], ["g"], ["all"], limit).collect()}
    assert of(None) == of(3000)
    plan = select.round_robin(rows, ["s"], ["g"], ["g"], ["all"])._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan  # no window over a whole scope
    big = spark.range(500_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("g"), F.lit(0).alias("all"))
    gapless(written(spark, select.round_robin(big, ["id"], ["g"], ["g"], ["all"]), tmp_path), "place")


def test_a_million_files_of_one_name(spark, tmp_path):
    plan = spark.range(1_000_000).select(F.format_string("s%07d", "id").alias("src"), F.lit("a/k.wav").alias("dest"))
    taken = spark.range(1, 400_000, 2).select(F.format_string("a/k-%d.wav", "id").alias("path"))
    got = written(spark, plans.unique_names(plan, "dest", "src", taken), tmp_path)
    n = F.coalesce(F.regexp_extract("dest", "-([0-9]+)[.]", 1).try_cast("long"), F.lit(1))
    r = got.agg(F.count("*").alias("n"), F.countDistinct("dest").alias("d"), F.max(n).alias("hi"), F.count_if((n > 1) & (n % 2 == 1) & (n < 400_000)).alias("bad")).first()
    assert (r.n, r.d, r.hi, r.bad) == (1_000_000, 1_000_000, 1_199_999, 0)


def brute_names(plan, taken, sep="-"):
    """Natural names first, then the first free number of each row in order."""
    wanted, used, out = {d for _, d in plan}, set(taken), {}
    for src, dest in sorted(plan):
        stem, dot, ext = dest.rpartition(".")
        n, name = 1, dest
        while name in used or (n > 1 and name in wanted):
            n += 1
            name = f"{stem}{sep}{n}{dot}{ext}"
        used.add(name)
        out[src] = name
    return out


def test_unique_names_against_one_by_one(spark):
    rng = random.Random(5)
    for _ in range(4):
        dests = [f"{rng.choice('ab')}/{rng.choice(['k', 'k-2', 'k-3', 'k-2-2', 'h-02', 'h-1', '-2'])}.wav" for _ in range(60)]
        plan = [(f"s{i:03}", d) for i, d in enumerate(dests)]
        taken = {rng.choice(["a/k-4.wav", "a/k.wav", "b/k-2-3.wav", "b/k-7.wav", "a/h-1-2.wav", "a/-2-2.wav"]) for _ in range(3)}
        got = plans.unique_names(spark.createDataFrame(plan, "src string, dest string"), "dest", "src", spark.createDataFrame([(t,) for t in taken], "path string"))
        assert dict((r.src, r.dest) for r in got.collect()) == brute_names(plan, taken)


def test_globs_meet_paths_without_a_nested_loop(spark):
    rng = random.Random(3)
    paths = sorted({"/".join([*rng.choices(["PACKS", "a", "b", "KICKS", "deep"], k=rng.randint(0, 3)), f"{rng.choice(['kick', 'open hat', 'k', 'x.y'])}{rng.randint(0, 9)}.{rng.choice(['wav', 'aif'])}"]) for _ in range(400)})
    globs = ["*.wav", "**/*.wav", "**/*kick*", "PACKS/**", "PACKS/*/k?.wav", "**/KICKS/*", "?/k[0-4].aif", "**", "*", "*/*", "a/b/*.wav", "[ab]/**/x.y*", "**/[!k]*.aif", "deep/*hat*", "**/deep/**/k1.*", "?"]
    lines = spark.createDataFrame([(i, g, None) for i, g in enumerate(globs)], "line int, pattern string, rename string")
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found, missing = plans.match_patterns(lines, files)

    def regex(glob):
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "[":
                j = glob.index("]", i)
                out, i = out + fnmatch.translate(glob[i : j + 1])[4:-3], j + 1
            else:
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
        return re.compile(out)

    want = {(i, p) for i, g in enumerate(globs) for p in paths if regex(g).fullmatch(p)}
    got = found.select("line", "path").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert {r.line for r in missing.collect()} == set(range(len(globs))) - {i for i, _ in want}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
