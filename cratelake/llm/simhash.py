"""Operator 7: SimHash near-duplicates through a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelake.llm.common import staged
from cratelake.llm.graph import components
from cratelake.llm.wordspans import slices

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Members up to which the pairs of a grid cell are compared one by one.
CELL = 64
EVEN = 0x5555555555555555


def majority(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each document the bits set in over half of its hashes."""
    lanes = h.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(n), 8), np.uint8)
    for j in range(8):
        seen = np.bincount(doc * 256 + lanes[:, j], minlength=len(n) * 256).reshape(len(n), 256)
        out[:, j] = np.packbits((seen @ _BITS) * 2 > n[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                raw, h, n = data.tobytes(), [], np.zeros(len(part), np.int64)
                for i in range(len(part)):
                    ws = raw[off[i] : off[i + 1]].lower().split()
                    if len(ws) > shingle:
                        line = b" ".join(ws)
                        edge = np.cumsum([0, *map(len, ws)]) + np.arange(len(ws) + 1)
                        mine = [digest(line[a:b], 42) for a, b in zip(edge[:-shingle].tolist(), (edge[shingle:] - 1).tolist(), strict=True)]
                    else:
                        mine = [digest(b" ".join(ws), 42)] if ws else []
                    n[i] = len(mine)
                    h += mine
                fp = majority(np.array(h, np.uint64), np.repeat(np.arange(len(n)), n), n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text's word shingles, repeats included, with XXH64.

    A-Z count as a-z. A text of fewer words is one shingle; without a word the fingerprint is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint(shingle), "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each count written in unary over its two bits: the
    Manhattan distance of two count vectors is the number of bits in which they differ, and never
    more than the fingerprints' Hamming distance."""
    odd = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    even = fp.bitwiseAND(F.lit(EVEN))
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def unary(fp: np.ndarray) -> np.ndarray:
    """``embed`` of an array of fingerprints."""
    even, odd = fp & np.uint64(EVEN), fp >> np.uint64(1) & np.uint64(EVEN)
    return even | odd | (even & odd) << np.uint64(1)


def counts(prints: np.ndarray) -> np.ndarray:
    """The bit counts of the two-bit segments of rows of fingerprints, 32 for each fingerprint."""
    one = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    return one[:, ::2] + one[:, 1::2]


def _masks(bits: int, blocks: int) -> list[int]:
    """Of ``blocks`` groups of segments at least blocks - bits are alike in two vectors at Manhattan
    distance ``bits`` or less; a mask for each choice of that many."""
    cuts = [round(32 * i / blocks) for i in range(blocks + 1)]
    one = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(one, blocks - bits)]


def _near(center: Column, radius: int) -> Column:
    """All values within ``radius`` bits of one."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flips = [signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(64), r)]
    return F.transform(F.lit(flips), lambda m: center.bitwiseXOR(m))


def links(prints: DataFrame, bits: int = 4, cell: int = CELL) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within ``bits``.

    Grid range join: a cell is a choice of coordinates of the popcount embedding; vectors within
    ``bits`` share a cell for some choice, cells are joined on equality, the Manhattan bound
    discards, the Hamming distance decides. More fingerprints get more, finer choices. A cell of
    over ``cell`` members isn't paired: two fingerprints are within 4 bits just if some value is
    within 2 of both, so there every member goes to all values within half the bits, and those that
    meet at a value (a bounded number, as fingerprints are distinct) are linked to the least one.
    """
    if bits % 2:
        raise ValueError("bits must be even")
    n = prints.count()
    blocks = bits + (4 if n < 1_000_000 else 5 if n < 20_000_000 else 7)
    u = embed(F.col("fp"))
    keys = F.array(*[F.struct(F.lit(i).alias("c"), u.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks(bits, blocks))])
    # the prints are few bytes, in few files: they are dealt to as many tasks as a shuffle has before they grow
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = prints.repartition(parts, "fp").select("fp", F.explode(keys).alias("x")).select("fp", F.xxhash64("x.c", "x.k").alias("cell"))
    met = staged(cells.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).filter("n > 1"), "cells")
    few = met.filter(F.col("n") <= cell).groupBy("cell").agg(F.collect_list("fp").alias("all"))
    close = lambda a, b: (b > a) & (F.bit_count(embed(a).bitwiseXOR(embed(b))) <= bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    pairs = few.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda b: close(F.col("a"), b))).alias("b"))
    many = met.filter(F.col("n") > cell).select("fp").distinct()
    met = many.select("fp", F.explode(_near(F.col("fp"), bits // 2)).alias("at")).groupBy("at").agg(F.sort_array(F.collect_set("fp")).alias("all"))
    stars = met.filter(F.size("all") > 1).select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 1 << 20)).alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = 5, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked by steps of at most
    ``bits`` differing bits; component_id is the least doc_id among them.

    Null and blank texts have fingerprint 0 and are one group; equal texts are always linked;
    repeated rows come out as often as they came in; rows with a null id keep a null component
    unless their fingerprint links them; an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, shingle), "prints")
    unique = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    e = links(unique.select("fp"), bits)
    a, b = unique.select(F.col("fp").alias("a"), F.col("first").alias("fa")), unique.select(F.col("fp").alias("b"), F.col("first").alias("fb"))
    roots = components(e.join(a, "a").join(b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    named = unique.join(roots, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = simhash_components(docs, shingle=4, bits=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
