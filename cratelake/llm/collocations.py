"""Operator 11: collocations of two to four words, counted in tiles of frequency-ranked ids."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratelake import staging
from cratelake.llm.common import discard

#: Characters of text of a language that are counted together, in one chunk; a longer text is in one chunk, whole.
CHUNK = 4_000_000
#: Ids on each side of a tile, as a power of two; a tile is counted densely where at least one in so many cells is met.
TILE, DENSE = 9, 16

#: Bytes of text to a bucket: what a task counts at a time, whatever the table's size and the number of partitions.
BUCKET_BYTES = 20_000_000

# What chunks have met is staged for two sizes of phrases at a time, and is most of the disk. A chunk is a row of megabytes.
staged = functools.partial(staging.staged, codec="zstd", group_bytes=8_000_000)

# Kinds of bytes: of words, between words, between pieces; and A-Z as a-z.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CODED = "lang string, chunk long, {keys}, counts array<array<int>>, starts array<int>, codes array<int>"
OFTEN = "lang string, chunk long, ats array<int>, ids array<int>, {keys}, fs array<long>"


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """A hash of the numbers."""
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _hashed(words: pa.LargeStringArray) -> np.ndarray:
    """A hash of each word, none of which is empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(_mixed(place << 8 | data), starts))


def _coded(lang: str, chunk: int, keys: dict[str, pa.Array], counts: np.ndarray, codes: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.Table:
    """One row: what was met in a chunk and how often, dealt into buckets by its hash, and where: a code for each place, which
    is the number of what stands there, across buckets, and -1 where there is none."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
    number = np.full(len(order) + 1, -1, np.int32)  # the last stands for -1
    number[order] = np.arange(len(order))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    dealt = lambda x: one(pa.ListArray.from_arrays(pa.array(starts), x.take(pa.array(order))))
    cols = {"lang": pa.array([lang]), "chunk": pa.array([chunk], pa.int64())} | {k: dealt(x) for k, x in keys.items()}
    return pa.table(cols | {"counts": dealt(pa.array(counts, pa.int32())), "starts": one(pa.array(starts[:-1])), "codes": one(pa.array(number[codes]))})


def _words(lang: str, chunk: int, texts: list[str], buckets: int) -> pa.Table:
    """Words of the texts of a chunk, and the places of each; a place between pieces or texts has none."""
    data = _LOWER[np.frombuffer("\n".join(texts).encode(), np.uint8)]
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[kind == 0]))
    met = words.dictionary_encode()
    own = met.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    gaps = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(kind == 2), starts))) + 1
    counts = np.bincount(own, minlength=len(met.dictionary))
    return _coded(lang, chunk, {"words": met.dictionary.cast(pa.string())}, counts, np.insert(own, gaps, -1), _hashed(met.dictionary), buckets)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in short ones, so that not all its texts are copied out at once."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _reader(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of the texts (lang, text) of a partition, numbered so that no two of the table are alike."""
        chunk, held, sizes = TaskContext.get().partitionId() << 32, {}, {}

        def emit(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            for lang in langs:
                yield from _words(lang, chunk, held.pop(lang), buckets).to_batches()
                sizes.pop(lang)
                chunk += 1

        for batch in itertools.chain.from_iterable(map(_slices, batches)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= CHUNK:
                    yield from emit([lang])
            if sum(sizes.values()) >= 4 * CHUNK:
                yield from emit(list(held))
        yield from emit(list(held))

    return read


def _counter(keys: list[str], least: int, placed: bool, buckets: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def counted(key: tuple[pa.Scalar, ...], met: pa.Table) -> pa.Table:
        """What is frequent of a bucket of a language: a row without a chunk that has the keys, their frequencies and ids, and, if
        ``placed``, a row a chunk with their numbers there and ids.

        A bucket numbers its keys by frequency, and takes every ``buckets``-th id: as keys are dealt by a hash, ids rank the
        keys of a language by frequency, nearly, and are its own without a sort of the table.
        """
        lang, bucket = key[0].as_py(), key[1].as_py()
        flat = lambda c: pc.list_flatten(met.column(c)).combine_chunks()
        if keys == ["words"]:
            words = flat("words").dictionary_encode()
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            own, distinct = words.indices.to_numpy(), [words.dictionary]
        else:
            pairs, own = np.unique(flat("us").to_numpy().astype(np.int64) << 32 | flat("vs").to_numpy(), return_inverse=True)
            distinct = [pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32())]
        f = np.zeros(len(distinct[0]), np.int64)
        np.add.at(f, own, flat("counts").to_numpy())
        often = np.flatnonzero(f >= least)
        often = often[np.argsort(-f[often], kind="stable")]
        ids = np.full(len(f), -1, np.int64)
        ids[often] = np.arange(len(often)) * buckets + bucket
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        cols = {"lang": pa.array([lang]), "chunk": pa.array([None], pa.int64()), "ats": pa.array([None], pa.list_(pa.int32())), "ids": one(pa.array(ids[often], pa.int32()))}
        cols |= {k: one(x.take(pa.array(often))) for k, x in zip(keys, distinct, strict=True)}
        out = pa.table(cols | {"fs": one(pa.array(f[often]))})
        if not placed:
            return out
        here = ids[own]
        hit = np.flatnonzero(here >= 0)
        sizes = pc.list_value_length(met.column("counts")).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        number = np.arange(len(own)) + (met.column("starts").to_numpy() - np.cumsum(sizes) + sizes)[row]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(sizes)))]), pa.int32())
        cols = {"lang": met.column("lang"), "chunk": met.column("chunk")}
        cols |= {"ats": pa.ListArray.from_arrays(ends, pa.array(number[hit], pa.int32())), "ids": pa.ListArray.from_arrays(ends, pa.array(here[hit], pa.int32()))}
        cols |= {k: pa.nulls(len(sizes), out.column(k).type) for k in [*keys, "fs"]}
        return pa.concat_tables([out, pa.table(cols).cast(out.schema)])

    return counted


def tiles(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ids (u[i], v[i]): their distinct us, vs and counts, and which of these each i is.

    A pair of ids is a cell of a tile, which is addressed directly: ids are ranked by frequency, so that a few tiles
    near the corner hold most pairs and are counted by ``bincount`` over all their cells. All other tiles are
    sorted together as coordinates.
    """
    size, mask = 1 << TILE, (1 << TILE) - 1
    tile = (u.astype(np.int64) >> TILE) << 32 | v.astype(np.int64) >> TILE
    cell = (u.astype(np.int64) & mask) << TILE | v.astype(np.int64) & mask
    order = np.argsort(tile, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(tile[order])) + 1, [len(order)]])
    full = np.flatnonzero(np.diff(bounds) * DENSE >= size * size)
    code, sparse, at = np.zeros(len(u), np.int64), np.ones(len(u), bool), 0
    us, vs, counts = [], [], []
    for k in full.tolist():
        rows = order[bounds[k] : bounds[k + 1]]
        n = np.bincount(cell[rows], minlength=size * size)
        met = np.flatnonzero(n)
        base = int(tile[rows[0]])
        us.append((base >> 32 << TILE) + (met >> TILE))
        vs.append(((base & 0xFFFFFFFF) << TILE) + (met & mask))
        counts.append(n[met])
        place = np.zeros(size * size, np.int64)
        place[met] = np.arange(at, at + len(met))
        code[rows], sparse[rows], at = place[cell[rows]], False, at + len(met)
    coo, where, n = np.unique((u.astype(np.int64) << 32 | v.astype(np.int64))[sparse], return_inverse=True, return_counts=True)
    code[sparse] = where + at
    return np.concatenate([*us, coo >> 32]), np.concatenate([*vs, coo & 0xFFFFFFFF]), np.concatenate([*counts, n]), code


def _pairer(buckets: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table, pa.Table], pa.Table]:
    def pairs(key: tuple[pa.Scalar, ...], coded: pa.Table, often: pa.Table) -> pa.Table:
        """The chunk with pairs of neighbours in place of what was met; ``often`` (ats, ids) are those of frequent ones."""
        codes = pc.list_flatten(coded.column("codes")).to_numpy()
        name = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)  # the last stands for -1
        name[pc.list_flatten(often.column("ats")).to_numpy()] = pc.list_flatten(often.column("ids")).to_numpy()
        here = name[codes]
        both = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        u, v, counts, code = tiles(here[both], here[both + 1])
        out = np.full(max(len(here) - 1, 0), -1, np.int32)
        out[both] = code
        return _coded(key[0].as_py(), key[1].as_py(), {"us": pa.array(u, pa.int32()), "vs": pa.array(v, pa.int32())}, counts, out, _mixed(u, v), buckets)

    return pairs


def _often(coded: DataFrame, keys: dict[str, str], least: int, placed: bool, buckets: int) -> DataFrame:
    """What ``_counter`` gives for all buckets of what the chunks have met; ``keys`` are columns and their types."""
    dealt = F.posexplode(F.arrays_zip(*keys, "counts", "starts")).alias("bucket", "_m")
    met = coded.select("lang", "chunk", dealt).select("lang", "chunk", "bucket", "_m.*").filter(F.size("counts") > 0)
    schema = OFTEN.format(keys=", ".join(f"{k} array<{kind}>" for k, kind in keys.items()))
    return staged(met.groupBy("lang", "bucket").applyInArrow(_counter(list(keys), least, placed, buckets), schema), "counted")


def phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, size, id, phrase, a, lefts, rights, inside), every phrase of 2 to ``longest`` words with a = f(phrase) >= ``least``; and
    (lang, n), the occurrences of words.

    lefts and rights are the frequencies of its first and its last 1, 2, .. words; inside is the highest frequency of a
    frequent phrase that is one word longer and holds it, if any.

    What a chunk has met is dealt by a hash into as many buckets as a shuffle has partitions, more where the texts have
    over ``BUCKET_BYTES`` for each, and shuffled as a row of arrays a chunk and bucket. A task holds one bucket of one
    language at a time.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // BUCKET_BYTES))
    # By a hash of few chunks some tasks get many of them, of megabytes each: a task to a chunk, where there are more chunks.
    spread = lambda df, *keys: df.repartition(total // CHUNK, *keys) if total // CHUNK > parts else df
    nested = lambda keys: CODED.format(keys=", ".join(f"{k} array<array<{kind}>>" for k, kind in keys.items()))
    keys, pair, levels = {"words": "string"}, {"us": "int", "vs": "int"}, []
    coded = staged(rows.mapInArrow(_reader(buckets), nested(keys)), "words")
    words = staged(coded.select("lang", F.explode(F.flatten("counts")).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    for size in range(1, longest + 1):
        counted = _often(coded, keys, least, size < longest, buckets)
        names = {k: k[:-1] for k in [*keys, "fs", "ids"]}
        often = counted.filter(F.col("chunk").isNull()).select("lang", F.explode(F.arrays_zip(*names)).alias("_m"))
        often = staged(often.select("lang", *[F.col(f"_m.{k}").alias(x) for k, x in names.items()]), "often")
        if size == 1:
            rows = often.select("lang", "id", "f", "word", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.array("f").alias("lefts"), F.array("f").alias("rights"))
        else:
            a = levels[-1].select("lang", F.col("id").alias("u"), F.col("phrase").alias("_head"), F.col("lefts").alias("_lefts"))
            b = levels[-1].select("lang", F.col("id").alias("v"), "tail", F.col("rights").alias("_rights"))
            rows = often.join(a, ["lang", "u"]).join(b, ["lang", "v"])
            rows = rows.select("lang", "id", "f", "u", "v", F.concat_ws(" ", "_head", "tail").alias("phrase"), "tail", F.concat("_lefts", F.array("f")).alias("lefts"), F.concat("_rights", F.array("f")).alias("rights"))
        levels.append(staged(rows, "ranks"))
        if size < longest:
            at = counted.filter(F.col("chunk").isNotNull()).select(F.col("lang").alias("_lang"), F.col("chunk").alias("_chunk"), "ats", "ids")
            places = spread(coded.select("lang", "chunk", "codes"), "lang", "chunk").groupBy("lang", "chunk")
            both = places.cogroup(spread(at, "_lang", "_chunk").groupBy("_lang", "_chunk"))
            pairs = both.applyInArrow(_pairer(buckets), nested(pair))
            pairs = staged(pairs if size + 1 < longest else pairs.drop("codes"), "pairs")  # the longest are counted only
            discard(coded)
            coded, keys = pairs, pair
        discard(counted)
        discard(often)
    discard(coded)
    out = None
    for size in range(2, longest + 1):
        rows = levels[size - 1].select("lang", F.lit(size).alias("size"), "id", "phrase", F.col("f").alias("a"), "lefts", "rights")
        if size < longest:  # what the longer ones hold: all words but their last, and all but their first
            held = levels[size].select("lang", F.explode(F.array("u", "v")).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("inside"))
            rows = rows.join(held, ["lang", "id"], "left")
        else:
            rows = rows.withColumn("inside", F.lit(None).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out, words


def collocations(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``most`` phrases of each language in documents (text, lang).

    A chunk of texts is read once into word codes; then words, and in turn pairs of words, of pairs and of triples that
    are frequent in the whole table get ids that rank them by frequency, nearly, and the neighbouring
    ids of each chunk are counted in tiles (``tiles``): two triples that overlap in two words are
    four words. Only counts of a chunk are shuffled, and its codes and ids; nothing is broadcast.

    A phrase that stands in a longer one with ``share`` per cent of its frequency or more goes; as a phrase is
    no more frequent than any part of it, the phrases that are one word longer decide this.

    Null and empty texts have no words, a null lang is ``und``; repeated rows count each; very long texts are chunks
    of their own; other columns are ignored; an empty table gives an empty result.
    """
    kept, words = phrases(docs, least)
    big = lambda c, d=19: F.col(c).cast(f"decimal({d},0)")
    kept = kept.filter(F.col("inside").isNull() | (big("inside") * 100 < big("a") * share))

    def cut(k):
        left, right = F.element_at("lefts", k), F.element_at("rights", F.col("size") - k)
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * big("a"), left.cast("decimal(19,0)") + right.cast("decimal(19,0)"))
        return F.struct(score.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))
    scored = kept.select("lang", "phrase", "a", best.alias("_b")).select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
    line = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= most)
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 collocations of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
