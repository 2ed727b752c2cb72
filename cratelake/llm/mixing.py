"""Operator 2: mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelake.llm.common import SPACE, staged

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Primes above any number of blocks, for the permutations of the passes.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: Sources up to which their targets, a row each, are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """Adds target to (source, source_size), a row a source.

    Sources in order of code points, null last, take the weights in turn and share the sum of all
    sizes by them; a target stops at ``most`` times its source's size and the excess is shared by
    weight among the others. Sorted by limit over weight, the stopped sources come first, and one
    pass of running sums finds the level at which the rest share what is left.
    """
    one = Window.partitionBy(F.lit(0))
    s = sources.withColumn("_i", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    s = s.withColumn("_w", w).withColumn("_top", F.lit(float(most)) * F.col("source_size")).withColumn("_total", F.sum(F.col("source_size").cast("double")).over(one))
    by = one.orderBy(F.col("_top") / F.col("_w"), "_i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_used", F.coalesce(F.sum("_top").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_rest")).withColumn("_stops", F.col("_top") / F.col("_w") <= F.col("_level"))
    level = F.min(F.when(~F.col("_stops"), F.struct(F.col("_top") / F.col("_w"), "_i", F.col("_level").alias("v")))).over(one)["v"]
    return s.withColumn("target", F.when(F.col("_stops"), F.col("_top")).otherwise(level * F.col("_w"))).select("source", "source_size", "target")


def _ln_factorial(n: Column) -> Column:
    """Stirling's series, begun eight higher."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - sum((F.ln(n.cast("double") + float(i)) for i in range(2, 9)), F.ln(n.cast("double") + 1.0))


def hypergeometric(drawn: Column, marked: Column, total: Column, u: Column) -> Column:
    """Number of marked items among ``drawn`` of ``total``, by inversion at ``u`` in (0, 1). The
    support is cut to where anything but a share of 1e-14 lies."""
    mean = drawn * marked / F.greatest(total, F.lit(1))
    sd = F.sqrt(F.greatest(mean * (total - marked) * (total - drawn) / F.greatest(total * (total - 1.0), F.lit(1.0)), F.lit(0.0)))
    lo = F.greatest(F.lit(0).cast("long"), drawn + marked - total, F.floor(mean - 9 * sd - 2))
    hi = F.least(drawn, marked, F.ceil(mean + 9 * sd + 2))
    choose = lambda n, k: _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
    p = lambda x: F.exp(choose(marked, x) + choose(total - marked, drawn - x) - choose(total, drawn))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("long").alias("x"))

    def step(a: Column, x: Column) -> Column:
        c = a["c"] + p(x)
        return F.struct(c.alias("c"), F.coalesce(a["x"], F.when(c >= u, x)).alias("x"))

    return F.coalesce(F.aggregate(F.sequence(lo, hi), start, step)["x"], hi)


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(_i, shard, first, n): which of a source's block draws each of 2**depth shards gets.

    A node of the tree holds how many draws of each source lie below it; its left half gets
    half of them all, source by source a hypergeometric draw from what is left, so that jointly
    they are a multivariate-hypergeometric one, and every source's quota is met exactly.
    ``quotas`` (_i, draws) is the recipe: a row a source, numbered from 0.
    """
    tree = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "draws"))), lambda x: x["draws"]).alias("left")).withColumn("node", F.lit(1).cast("long"))
    for level in range(depth):
        total = F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x)
        t = tree.withColumn("total", total).withColumn("half", F.floor(F.col("total") / 2))
        zero = F.struct(F.col("half").alias("d"), F.col("total").alias("t"), F.array().cast("array<long>").alias("got"))

        def draw(a: Column, x: Column) -> Column:
            u = (F.pmod(F.xxhash64(F.lit(seed), F.col("node"), F.size(a["got"])), F.lit(1 << 32)).cast("double") + 0.5) / float(1 << 32)
            k = hypergeometric(a["d"], x, a["t"], u).cast("long")
            return F.transform(F.array(k), lambda k: F.struct((a["d"] - k).alias("d"), (a["t"] - x).alias("t"), F.concat(a["got"], F.array(k)).alias("got")))[0]

        t = t.withColumn("got", F.aggregate("left", zero, draw)["got"])
        rest = F.zip_with("left", "got", lambda a, b: a - b)
        two = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("got").alias("left")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("left")))
        tree = t.select(F.explode(two).alias("x")).select("x.node", "x.left")
        tree = staged(tree if level < 8 else tree.repartition("node"), "tree")
    leaf = tree.select((F.col("node") - (1 << depth)).alias("shard"), F.posexplode("left").alias("_i", "n"))
    run = Window.partitionBy("_i").orderBy("shard")
    return leaf.withColumn("first", F.sum("n").over(run) - F.col("n")).select("_i", "shard", "first", "n")


def _copies(docs: DataFrame, cols: list[str], chunk: int = 4096) -> DataFrame:
    """Rows with ``copy``, a number among equal rows. Many copies of a row are dealt out in chunks."""
    held = staged(docs.groupBy(*cols).agg(F.count("*").alias("_n")), "rows")
    if held.filter("_n > 1").isEmpty():
        return held.select(*cols, F.lit(0).cast("long").alias("copy"))
    chunks = held.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk)))).repartition(*cols, "_c")
    first = F.col("_c") * chunk
    return chunks.select(*cols, F.explode(F.sequence(first, F.least(first + chunk, F.col("_n")) - 1)).alias("copy"))


def _rank(block: Column, blocks: Column, turn: Column, seed: int) -> Column:
    """A permutation of a source's blocks for each pass: times a prime above any number of blocks,
    plus a shift, modulo that number."""
    by = F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (turn % len(PRIMES) + 1).cast("int"))
    return F.pmod(block * by + F.pmod(F.xxhash64(F.lit(seed), turn, blocks), blocks), blocks)


def _crossing(blocks: DataFrame, group: int = 4096) -> DataFrame:
    """(_i, _last, _left): of each source the rank of the block in which its part pass reaches what is
    left of the target, and how many words that block still gives. Sums are run over groups of
    blocks first, then inside the one group, so that no window holds all blocks of a source."""
    b = blocks.withColumn("_g", F.floor(F.col("_rank") / group))
    run = lambda keys, by: F.sum("_words").over(Window.partitionBy(*keys).orderBy(by)) - F.col("_words")
    hit = lambda before: (before < F.col("_part")) & (before + F.col("_words") >= F.col("_part"))
    groups = b.groupBy("_i", "_g").agg(F.sum("_words").alias("_words"), F.first("_part").alias("_part")).withColumn("_ahead", run(["_i"], "_g"))
    groups = groups.filter(hit(F.col("_ahead"))).select("_i", "_g", "_ahead")
    inside = b.join(groups, ["_i", "_g"]).withColumn("_before", F.col("_ahead") + run(["_i", "_g"], "_rank")).filter(hit(F.col("_before")))
    return inside.select("_i", F.col("_rank").alias("_last"), (F.col("_part") - F.col("_before")).alias("_left"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, block_rows: int = 256, shard_draws: int = 128, seed: int = 17, key: tuple = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, size) with copy, source_size, target and its draws, an
    array of (pass, shard, place) that is empty for a row which the mix leaves out.

    A source's documents are cut into blocks by a hash; each pass draws its blocks in another
    permuted order. Whole passes and blocks of a last one, up to that in which the target is
    reached, are the source's quota of draws. The splitting tree parts all quotas among
    2 ** depth shards, of some ``shard_draws`` draws each; a shard draws a stretch of each source's
    permuted blocks, disjoint from the others'; the shard that has a source's last draw gives of
    that block only the documents up to the target. ``place`` orders a shard's documents at random.
    All is fixed by the data and the seed.

    Null sources are one source, the last; null ids and repeated rows are drawn each for itself (copy
    numbers equal rows); null sizes are 0; an empty table gives an empty result. Columns ``key``
    tell rows of one id apart.
    """
    cols = ["doc_id", *key, "source", "size"]
    sized = docs.select("doc_id", *key, "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    rows = _copies(sized, cols)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    goal = targets(sources.select("source", "source_size"), weights, most)
    goal = goal.join(sources.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = goal.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    goal = goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("_part", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")).withColumn("_blocks", F.ceil(F.col("_rows") / block_rows))
    goal = staged(goal, "goal")
    few = goal.count() <= BROADCAST_SOURCES
    g = goal.select(F.col("source").alias("_s"), "_i", "source_size", "target", "_whole", "_part", "_blocks")
    rows = rows.join(F.broadcast(g) if few else g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size", *key, "copy"))
    rows = staged(rows.withColumn("_block", F.pmod("_key", F.col("_blocks"))), "blocks")
    blocks = rows.groupBy("_i", "_block").agg(F.sum("size").alias("_words"), *[F.first(c).alias(c) for c in ("_whole", "_part", "_blocks")])
    blocks = staged(blocks.withColumn("_rank", _rank(F.col("_block"), F.col("_blocks"), F.col("_whole"), seed + 2)), "blocks")
    cut = staged(_crossing(blocks), "cut")
    quota = goal.join(cut, "_i", "left").select("_i", (F.col("_whole") * F.col("_blocks") + F.coalesce(F.col("_last") + 1, F.lit(0))).cast("long").alias("draws"))
    draws = quota.agg(F.sum("draws")).first()[0] or 0
    depth = max(4, math.ceil(math.log2(max(1, draws / shard_draws))))
    stretch = split_quotas(quota, depth, seed).filter("n > 0")
    # a draw meets its shard's stretch in a cell of positions, so that the join is on equality
    cell = 64
    at = lambda x: F.floor(x / cell)
    stretch = stretch.withColumn("_cell", F.explode(F.sequence(at(F.col("first")), at(F.col("first") + F.col("n") - 1))))
    drawn = blocks.join(F.broadcast(cut) if few else cut, "_i", "left").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole"))))
    drawn = drawn.withColumn("_rank", _rank(F.col("_block"), F.col("_blocks"), F.col("pass"), seed + 2)).filter((F.col("pass") < F.col("_whole")) | (F.col("_rank") <= F.col("_last")))
    drawn = drawn.withColumn("_at", F.col("pass") * F.col("_blocks") + F.col("_rank")).withColumn("_cell", at(F.col("_at")))
    dealt = drawn.join(stretch, ["_i", "_cell"]).filter((F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("first") + F.col("n")))
    # of a source's last draw those documents are given, the longest first, that still fit what is left
    part = (F.col("pass") == F.col("_whole")) & (F.col("_rank") == F.col("_last"))
    dealt = dealt.groupBy("_i", "_block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", F.coalesce(part, F.lit(False)).alias("part")))).alias("_draws"))
    inner = Window.partitionBy("_i", "_block").orderBy(F.desc("size"), "_key", *cols[:-2], "copy")
    rows = rows.withColumn("_no", F.row_number().over(inner))
    last = staged(blocks.join(F.broadcast(cut) if few else cut, (blocks["_i"] == cut["_i"]) & (blocks["_rank"] == cut["_last"])).select(blocks["_i"], "_block", "_left"), "last")
    in_last = rows.join(F.broadcast(last) if few else last, ["_i", "_block"])
    none = F.struct(F.col("_left").alias("left"), F.array().cast("array<int>").alias("given"))
    fits = lambda a, d: F.when(d["size"] <= a["left"], F.struct((a["left"] - d["size"]).alias("left"), F.concat(a["given"], F.array(d["_no"])).alias("given"))).otherwise(a)
    chosen = in_last.groupBy("_i", "_block", "_left").agg(F.sort_array(F.collect_list(F.struct("_no", "size"))).alias("_all"))
    chosen = chosen.select("_i", "_block", F.aggregate("_all", none, fits)["given"].alias("_given"))
    dealt = dealt.join(chosen, ["_i", "_block"], "left")
    out = rows.join(dealt, ["_i", "_block"], "left")
    given = F.filter(F.coalesce("_draws", F.array()), lambda d: ~d["part"] | F.array_contains("_given", F.col("_no")))
    place = lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 3), d["shard"], d["pass"], F.col("_key")).alias("place"))
    return out.select(*cols, "copy", "source_size", "target", F.transform(given, place).alias("draws"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The draws of ``plan``, a row each: doc_id, source, size, copy, source_size, target, pass, shard, place."""
    p = plan(docs, **options)
    return p.withColumn("_d", F.explode("draws")).select(*[c for c in p.columns if c != "draws"], "_d.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents; rows of one id are told apart by their texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = plan(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text")), key=("_text",))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "source", "draws")
