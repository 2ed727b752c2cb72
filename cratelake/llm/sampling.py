"""Operator 1: document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelake.llm.common import staged, words

#: Samples of a fingerprint, and how many of them a row of the aggregation draws.
SAMPLES, CHUNK = 64, 4


def signatures(texts: DataFrame, key: str, columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """(key, one array of ``samples`` ints for each text column).

    A text is a bag of words. For sample k a word has r and c from Gamma(2, 1), each the negative
    logarithm of a product of two uniform numbers, and b from U(0, 1), all from 128 hash bits of the
    word and k; at weight w it has t = floor(ln w / r + b) and a = c exp(-r (t - b + 1)), and the
    sample is a hash of the word and t where a is least. Two texts agree in a sample with the
    probability of their generalised Jaccard similarity, the sum of the lesser by that of the greater
    weights, however many words they have.

    ``texts`` should come partitioned by ``key``, which identifies its rows: then no word is
    shuffled. Null texts are empty; the samples of a text without a word are all 0.
    """
    sized = texts.select(key, *[words(F.col(c)).alias(f"_w{i}") for i, c in enumerate(columns)])
    sized = sized.select(key, *[F.size(f"_w{i}").alias(f"_n{i}") for i in range(len(columns))], F.concat(*[f"_w{i}" for i in range(len(columns))], F.array(F.lit(""))).alias("_all"))
    each = sized.select(key, *[f"_n{i}" for i in range(len(columns))], F.posexplode("_all").alias("_at", "_word"))
    ends = [reduce(lambda a, b: a + b, [F.col(f"_n{j}") for j in range(i + 1)]) for i in range(len(columns))]
    inside = [(F.col("_at") < e) & (F.col("_at") >= (ends[i - 1] if i else F.lit(0))) for i, e in enumerate(ends)]
    bag = each.groupBy(key, F.xxhash64("_word").alias("_h")).agg(*[F.sum(x.cast("int")).alias(f"_f{i}") for i, x in enumerate(inside)])
    # a row a weight: mostly a word weighs the same in all columns that have it, and is drawn for once
    cs = range(len(columns))
    weights = F.array_distinct(F.array(*[F.col(f"_f{c}") for c in cs]))
    bag = bag.select(key, "_h", *[f"_f{c}" for c in cs], F.explode(weights).alias("_f"))
    bag = bag.select(key, "_h", *[((F.col(f"_f{c}") == F.col("_f")) & (F.col("_f") > 0)).alias(f"_has{c}") for c in cs], F.ln(F.greatest(F.col("_f"), F.lit(1)).cast("double")).alias("_l"))
    dealt = bag.select("*", F.explode(F.array(*[F.lit(j) for j in range(samples // CHUNK)])).alias("_j"))
    # two hashes a sample: 24 bits for each of the four uniform numbers behind r and c, 32 for b
    drawn = dealt.select("*", *[F.xxhash64("_h", F.col("_j") * CHUNK + i).alias(f"_x{i}") for i in range(CHUNK)])
    drawn = drawn.select("*", *[F.xxhash64(f"_x{i}").alias(f"_y{i}") for i in range(CHUNK)])
    bits = lambda x, low, n: F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1))
    uniform = lambda x, low: (bits(x, low, 24).cast("double") + 0.5) * 2.0**-24
    gamma = lambda x: -F.ln(uniform(x, 40) * uniform(x, 16))
    mixed = lambda i: F.shiftleft(bits(f"_x{i}", 0, 16), 16).bitwiseOR(bits(f"_y{i}", 0, 16))
    has = [f"_has{c}" for c in cs]
    tag = lambda i: F.col(f"_x{i}").bitwiseXOR(F.shiftrightunsigned(f"_y{i}", 32)).alias(f"_s{i}")
    drawn = drawn.select(
        key, "_j", *has, "_l", *[tag(i) for i in range(CHUNK)], *[gamma(f"_x{i}").alias(f"_r{i}") for i in range(CHUNK)],
        *[gamma(f"_y{i}").alias(f"_c{i}") for i in range(CHUNK)], *[(mixed(i).cast("double") * 2.0**-32).alias(f"_b{i}") for i in range(CHUNK)],
    )
    keep = [key, "_j", *has, *[f"_{x}{i}" for x in "srcb" for i in range(CHUNK)]]
    drawn = drawn.select(*keep, *[F.floor(F.col("_l") / F.col(f"_r{i}") + F.col(f"_b{i}")).alias(f"_t{i}") for i in range(CHUNK)])

    def value(i: int) -> Column:
        """Rank by a in the high bits, the sample in the low ones: one least long gives both. The
        fourth root keeps small values apart: a is at most c, some 36, and 1 / words where it counts."""
        a = F.col(f"_c{i}") * F.exp(-F.col(f"_r{i}") * (F.col(f"_t{i}").cast("double") - F.col(f"_b{i}") + 1.0))
        sample = F.col(f"_s{i}").bitwiseXOR(F.col(f"_t{i}")).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft((F.sqrt(F.sqrt(a)) * float(1 << 29)).cast("long"), 32).bitwiseOR(sample)

    drawn = drawn.select(key, "_j", *has, *[value(i).alias(f"_v{i}") for i in range(CHUNK)])
    got = drawn.groupBy(key, "_j").agg(*[F.min(F.when(F.col(f"_has{c}"), F.col(f"_v{i}"))).alias(f"_m{c}_{i}") for c in cs for i in range(CHUNK)])
    low = lambda c, i: F.coalesce(F.col(f"_m{c}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))
    parts = got.select(key, F.struct("_j", *[F.array(*[low(c, i) for i in range(CHUNK)]).alias(f"v{c}") for c in range(len(columns))]).alias("_p"))
    whole = parts.groupBy(key).agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return whole.select(key, *[F.flatten(F.col(f"_p.v{c}")).alias(name) for c, name in enumerate(columns)])


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def ring(ids: DataFrame) -> DataFrame:
    """Adds next_id, the following doc_id in ascending order, of the last the first. Ids are cut into
    ranges; within a range a window finds the next, and the first of each range, one row a range,
    serves the range before."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(ids.repartitionByRange(parts, "doc_id").withColumn("_range", F.spark_partition_id()), "ranges")
    firsts = cut.groupBy("_range").agg(F.min("doc_id").alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("_range", F.coalesce(F.lead("_first").over(order), F.min("_first").over(whole)).alias("_after"))
    led = cut.withColumn("_lead", F.lead("doc_id").over(Window.partitionBy("_range").orderBy("doc_id")))
    return led.join(F.broadcast(after), "_range").withColumn("next_id", F.coalesce("_lead", "_after")).drop("_lead", "_after", "_range")


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without null ids; of rows that share an id the one with the least text stays."""
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.min("text").alias("text"))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Null and blank texts have a fingerprint of zeros; rows without an id are left out; rows that
    share an id are one document, that of the least text; an empty table gives an empty result."""
    docs = one_row_an_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = ring(docs.select("doc_id", F.length("text").cast("long").alias("n_chars")))
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_for"), F.floor(F.col("n_chars") / 4).cast("int").alias("_take"))
    heads = docs.join(asked, "doc_id").select(F.col("_for").alias("doc_id"), F.substring("text", F.lit(1), F.col("_take")).alias("_head"))
    n = F.length("text")
    both = docs.join(heads, "doc_id").select("doc_id", "text", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), "_head").alias("edited"))
    prints = signatures(both, "doc_id", ["text", "edited"])
    facts = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    made = staged(prints.join(facts, "doc_id"), "signatures")
    following = made.select(F.col("doc_id").alias("next_id"), F.col("text").alias("_next"))
    linked = made.join(order.select("doc_id", "next_id"), "doc_id").join(following, "next_id")
    return linked.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("text")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("_next")).alias("near_next"),
    )
