"""A training corpus from raw documents, stage by stage; each stage calls one operator.

A stage returns the columns of its documents, whatever their names, but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelake.llm import language, mixing, neardup, packing, suffixes
from cratelake.llm.common import staged
from cratelake.llm.documents import Documents, packed_row, text_key, unpacked

#: Nats a trigram by which a text may be less likely than its language's own texts; a text in a language
#: that was not learnt lies further off, and a short text varies more.
MOST_SURPRISE, SHORT = 2.5, 10.0
#: Words of a passage that is cut where it stands again.
PASSAGE = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those of no language that the model knows."""
    model = language.fit(docs.filter(~language.held_out()))
    got = language.detect(docs, model)
    most = MOST_SURPRISE + SHORT / F.sqrt(F.greatest(F.length("text"), F.lit(1)))
    return unpacked(got.filter((F.col("lang_pred") != "und") & (F.col("surprise") <= most)), docs.columns, text="text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) the row with the least id
    stays, of its repeats one; rows without an id stay."""
    groups = staged(neardup.groups(docs).filter("doc_id IS NOT NULL"), "groups")
    row = F.struct("doc_id", "key")
    least = groups.groupBy("root").agg(F.min(row).alias("_least"))
    copies = groups.join(least, "root").filter(row != F.col("_least")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k")).distinct()
    rows = docs.select(packed_row(docs), F.col("text").cast("string").alias("text")).withColumn("_key", text_key(F.col("text")))
    left = rows.join(copies, (F.col("doc.doc_id") == F.col("_id")) & (F.col("_key") == F.col("_k")), "left_anti")
    twice = groups.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_k")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if not twice.isEmpty():
        twice = staged(twice, "twice")
        same = lambda t: (F.col("doc.doc_id") == t["_id"]) & (F.col("_key") == t["_k"])
        once = left.join(twice, same(twice), "left_semi").withColumn("_id", F.col("doc.doc_id")).dropDuplicates(["_id", "_key"]).drop("_id")
        left = left.join(twice, same(twice), "left_anti").unionByName(once)
    return unpacked(left, docs.columns, text="text")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand earlier are cut out; what is left empty goes. Rows of one
    id are documents in the order of their texts' hashes, rows without an id come last."""
    d = Documents(docs)
    runs = suffixes.repeated_windows(d.texts, PASSAGE, 16)
    cut = d.without(runs.select("doc_id", "start", (F.col("n") + (PASSAGE - 1)).alias("n_words")), PASSAGE)
    cut = cut.filter("n_removed < n_words OR n_removed = 0").withColumn("_n", F.length("out").cast("long"))
    return unpacked(cut, docs.columns, text="out", **{"n_chars": "_n"} if "n_chars" in docs.columns else {})


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each draw, shard by shard in the drawn order.

    Rows are told apart by a hash of all their columns and an ordinal among equal rows, so that those
    without an id or with a repeated one are drawn like any, each to its own text.
    """
    rows = docs.select(packed_row(docs), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64(*[x for c in docs.columns for x in [F.col("text") if c == "text" else F.col("doc").getField(c)] for x in (F.isnull(x), x)]))
    sized = staged(rows.select("row", "doc.doc_id", "doc.source", mixing.n_words(F.col("text")).alias("size")), "rows")
    if not sized.groupBy("row").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["row"])
    draws = mixing.mix(sized, key=("row",)).select("row", "shard", "place", "copy")
    out = rows.join(draws, "row").repartition("shard").sortWithinPartitions("shard", "place", "copy")
    return unpacked(out, docs.columns, text="text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all drawn texts in sequences of up to 1024 tokens."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixing", mixed), ("packing", packed)]

#: Hashes, EM and token ids can't be had in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
