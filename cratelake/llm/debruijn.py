"""Operator 4: repeated passages as nonbranching paths of a De Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratelake.llm.common import staged
from cratelake.llm.documents import Documents, compact
from cratelake.llm.graph import components
from cratelake.llm.wordspans import SPANS, cut_words, diagonals, grams, mix, slices, sliding_min, word_hashes

#: Documents whose minimisers tell which are hot, and the share of them (at least so many runs) from
#: which one is. This decides only where edges meet, not which are equal.
SAMPLE, HOT_SHARE, HOT_RUNS = 20_000, 0.005, 64
#: Bytes of text to a bucket of edges, and edges of a bucket that are compared at a time.
BUCKET_BYTES, TOGETHER = 16_000_000, 4_000_000
#: Positions of a source to a cell, in which its paths and the runs on them meet.
CELL = 256
ROWS = "bucket int, keys binary, docs binary, starts binary, counts binary, tags binary, " + SPANS
_PACKED = (("keys", 5), ("docs", 8), ("starts", 4), ("counts", 2), ("tags", 8))
_SPAN = {"doc_id": pa.int64(), "start": pa.int32(), "n": pa.int32(), "src_doc": pa.int64(), "src_start": pa.int32()}


def _edges(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray, k: int, minimiser: int):
    """Of every edge (a run of ``k`` words of a document): its hash, its minimiser, document and start."""
    s, e, d = cut_words(data, off)
    if len(s) < k:
        return None
    at = np.flatnonzero(d[: len(d) - k + 1] == d[k - 1 :])
    if not len(at):
        return None
    h = word_hashes(data, s, e)
    begin = np.searchsorted(d, np.arange(len(off)), "left")
    ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    return grams(h, k)[at], sliding_min(grams(h, minimiser), k - minimiser + 1)[at], ids[d[at]], at - begin[d[at]]


def _runs(low: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Where runs of edges with one minimiser begin."""
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    return np.flatnonzero(new)


def hot_minimisers(texts: DataFrame, k: int, minimiser: int) -> np.ndarray:
    """Minimisers that are common in a sample of some ``SAMPLE`` documents; at most a few times
    1 / ``HOT_SHARE`` of them for each hundred words of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                if (found := _edges(part, data, off, k, minimiser)) is not None:
                    _, low, doc, pos = found
                    yield pa.RecordBatch.from_arrays([pa.array(low[_runs(low, doc, pos)].view(np.int64))], ["key"])

    n = texts.count()
    some = texts if n <= SAMPLE else texts.sample(SAMPLE / n, seed=5)
    counts = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= max(HOT_RUNS, HOT_SHARE * min(n, SAMPLE))).select("key").toArrow().column("key").to_numpy().view(np.uint64)


def _spans(x: dict[str, np.ndarray], rest: bool) -> pa.RecordBatch:
    n = len(x["doc_id"])
    cols = {c: pa.array(x[c], t) for c, t in _SPAN.items()}
    if rest:
        cols = {"bucket": pa.array(mix(x["doc_id"].view(np.uint64)).astype(np.uint32) >> np.uint32(1), pa.int32())} | {c: pa.nulls(n, pa.binary()) for c, _ in _PACKED} | cols
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _deal(k: int, minimiser: int, buckets: int, hot: np.ndarray):
    """Edges by buckets of minimisers, a row a slice of texts and bucket; those of hot minimisers by
    their own hashes. Of equal edges in a slice only the first goes on; the others are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.take(pc.sort_indices(whole, [("doc_id", "ascending")]))
            for part, data, off in slices(whole, "text"):
                if (found := _edges(part, data, off, k, minimiser)) is None:
                    continue
                edge, low, doc, pos = found
                _, first, of = np.unique(edge, return_index=True, return_inverse=True)
                lead = first[of]
                again = lead != np.arange(len(edge))
                if again.any():
                    yield _spans(diagonals(doc[again], pos[again], doc[lead[again]], pos[lead[again]]), True)
                own = ~again
                edge, low, doc, pos = edge[own], low[own], doc[own], pos[own]
                if len(hot):
                    low = np.where(np.isin(low, hot), mix(edge), low)
                begin = _runs(low, doc, pos)
                n, key = np.diff(np.append(begin, len(low))), low[begin]
                bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                begin, n, key, bucket = begin[order], n[order], key[order], bucket[order]
                tags = edge[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                cells = np.append(0, np.cumsum(n))
                keys = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                cols = [pa.array(bucket[cut[:-1]])]
                for (_, size), x, at in zip(_PACKED, (keys, doc[begin].astype("<i8"), pos[begin].astype("<i4"), n.astype("<u2"), tags.astype("<u8")), (cut, cut, cut, cut, cells[cut]), strict=True):
                    cols.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]))
                cols += [pa.nulls(len(cut) - 1, t) for t in _SPAN.values()]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", *[c for c, _ in _PACKED], *_SPAN])

    return run


def _meet(together: int):
    """Rows come by bucket; edges of a bucket that are equal are repeats of the first of them. A bucket of
    over ``together`` edges is compared in parts by their hashes. Runs that are known to repeat go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def bucket() -> Iterator[pa.RecordBatch]:
            raw = {c: np.frombuffer(b"".join(x for b in held for x in b.column(c).to_pylist()), np.uint8) for c, _ in _PACKED}
            keys = np.zeros((len(raw["keys"]) // 5, 8), np.uint8)
            keys[:, :5] = raw["keys"].reshape(-1, 5)
            n = raw["counts"].view("<u2").astype(np.int64)
            tags, end, lows = raw["tags"].view("<u8"), np.cumsum(n), keys.view("<u8")[:, 0]
            parts = max(1, -(-len(tags) // together))
            for part in range(parts):
                own = np.flatnonzero(tags % np.uint64(parts) == part) if parts > 1 else np.arange(len(tags))
                row = np.searchsorted(end, own, "right")
                doc, tag, key = raw["docs"].view("<i8")[row], tags[own], lows[row]
                pos = raw["starts"].view("<i4").astype(np.int64)[row] + own - (end - n)[row]
                by_place = np.lexsort((pos, doc))
                doc, tag, key, pos = doc[by_place], tag[by_place], key[by_place], pos[by_place]
                _, first, of = np.unique(mix(key) ^ tag, return_index=True, return_inverse=True)
                lead = first[of]
                again = (lead != np.arange(len(lead))) & (key[lead] == key) & (tag[lead] == tag)
                yield _spans(diagonals(doc[again], pos[again], doc[lead[again]], pos[lead[again]]), False)

        now = None
        for b in batches:
            through = pc.is_null(b.column("keys"))
            if (plain := b.filter(through)).num_rows:
                yield plain.select(list(_SPAN))
            b = b.filter(pc.invert(through))
            at = b.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for x, y in zip(edges, edges[1:], strict=False):
                if y > x:
                    if held and at[x] != now:
                        yield from bucket()
                        held.clear()
                    now = at[x]
                    held.append(b.slice(x, y - x))
        if held:
            yield from bucket()

    return run


def repeated_edges(texts: DataFrame, k: int = 20, minimiser: int = 10) -> DataFrame:
    """Occurrences of repeated edges, as runs (doc_id, start, n, src_doc, src_start): edges start ..
    start+n-1 of doc_id equal those at src_start .. of src_doc, which come before them in the order of
    (doc_id, start). An edge is a run of ``k`` words; its first place is its name. Every occurrence of
    an edge that has an earlier one is in a row. ``texts`` (doc_id, text) has an id once."""
    hot = hot_minimisers(texts, k, minimiser)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    dealt = texts.mapInArrow(_deal(k, minimiser, buckets, hot), ROWS).repartition("bucket").sortWithinPartitions("bucket")
    return compact(dealt.mapInArrow(_meet(TOGETHER), SPANS))


def paths(runs: DataFrame) -> DataFrame:
    """Nonbranching paths of the graph of repeated edges, in pieces (path, doc, lo, hi): edges lo .. hi-1
    of doc, by their first places.

    Edges that follow one another at their first place are joined by a node; so are the last edge of a
    run and the first one of the run that goes on from it elsewhere. Where a node has two edges in
    or out, paths end. Runs are compacted by joins: first places to stretches, these cut at the
    branching nodes, and pieces that meet at a node with one edge in and out linked to one path.
    """
    by_doc = Window.partitionBy("doc").orderBy("lo", "hi")
    s = runs.select(F.col("src_doc").alias("doc"), F.col("src_start").alias("lo"), (F.col("src_start") + F.col("n")).alias("hi")).distinct()
    s = s.withColumn("_new", (F.coalesce(F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col("lo")).cast("int"))
    s = s.withColumn("_at", F.sum("_new").over(by_doc)).groupBy("doc", "_at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_at")
    s = staged(s, "stretches")
    line = Window.partitionBy("doc_id").orderBy("start", "src_doc")
    nxt = lambda c: F.lead(c).over(line)
    steps = runs.select("*", nxt("start").alias("_start"), nxt("src_doc").alias("to_doc"), nxt("src_start").alias("to")).filter(F.col("_start") == F.col("start") + F.col("n"))
    steps = staged(steps.select(F.col("src_doc").alias("from_doc"), (F.col("src_start") + F.col("n") - 1).alias("from"), "to_doc", "to").distinct(), "steps")
    outs, ins = steps.groupBy("from_doc", "from").agg(F.count("*").alias("_outs")), steps.groupBy("to_doc", "to").agg(F.count("*").alias("_ins"))
    cells = lambda t, lo, hi: t.withColumn("_cell", F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL))))
    held = cells(s, F.col("lo"), F.col("hi") - 1)

    def goes_on(doc: str, at: str) -> DataFrame:
        """Points with whether the edge has a next (or one before) at its first place."""
        points = steps.select(doc, at).distinct().withColumn("_cell", F.floor(F.col(at) / CELL))
        j = points.join(held, (points[doc] == held["doc"]) & (points["_cell"] == held["_cell"]) & (points[at] >= held["lo"]) & (points[at] < held["hi"]))
        return j.select(doc, at, (F.col(at) + 1 < F.col("hi")).cast("int").alias("_after"), (F.col(at) > F.col("lo")).cast("int").alias("_before"))

    ends = outs.join(goes_on("from_doc", "from"), ["from_doc", "from"]).select("from_doc", "from", (F.col("_outs") + F.col("_after")).alias("_outs"), "_after")
    begins = ins.join(goes_on("to_doc", "to"), ["to_doc", "to"]).select("to_doc", "to", (F.col("_ins") + F.col("_before")).alias("_ins"), "_before")
    ends, begins = staged(ends, "ends"), staged(begins, "begins")
    cuts = ends.filter("_after = 1").select(F.col("from_doc").alias("doc"), (F.col("from") + 1).alias("at"))
    cuts = cuts.unionByName(begins.filter("_before = 1").select(F.col("to_doc").alias("doc"), F.col("to").alias("at"))).distinct().withColumn("_cell", F.floor(F.col("at") / CELL))
    inner = cuts.join(held, ["doc", "_cell"]).filter((F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))).select("doc", "lo", F.col("at").alias("_cut"))
    cut = s.join(inner.groupBy("doc", "lo").agg(F.collect_set("_cut").alias("_cuts")), ["doc", "lo"], "left")
    bounds = F.sort_array(F.array_distinct(F.concat(F.array("lo", "hi"), F.coalesce("_cuts", F.array().cast("array<int>")))))
    pieces = cut.select("doc", bounds.alias("_b")).select("doc", F.explode(F.arrays_zip(F.col("_b").alias("lo"), F.slice("_b", 2, F.size("_b")).alias("hi"))).alias("x")).select("doc", "x.lo", "x.hi").filter("hi IS NOT NULL")
    pieces = staged(pieces.withColumn("_id", F.xxhash64("doc", "lo")), "pieces")
    alone = steps.join(ends.filter("_outs = 1").select("from_doc", "from"), ["from_doc", "from"]).join(begins.filter("_ins = 1").select("to_doc", "to"), ["to_doc", "to"])
    a = pieces.select(F.col("doc").alias("from_doc"), (F.col("hi") - 1).alias("from"), F.col("_id").alias("a"))
    b = pieces.select(F.col("doc").alias("to_doc"), F.col("lo").alias("to"), F.col("_id").alias("b"))
    linked = components(alone.join(a, ["from_doc", "from"]).join(b, ["to_doc", "to"]).select("a", "b"))
    return pieces.join(linked, F.col("_id") == F.col("node"), "left").select(F.coalesce("root", "_id").alias("path"), "doc", "lo", "hi")


def debruijn_repeats(texts: DataFrame, k: int = 20, minimiser: int = 10) -> DataFrame:
    """(doc_id, start, n_words, src_doc, src_start, path): words start .. start+n_words-1 of doc_id are those
    at src_start of src_doc and stand on a nonbranching path of repeated edges of ``k`` words.

    ``texts`` (doc_id, text) has an id once. Null and blank texts give no rows; of equal texts all but
    the first repeat; an empty table gives an empty result.
    """
    runs = staged(repeated_edges(texts, k, minimiser), "runs")
    cells = lambda t, lo, n: t.withColumn("_cell", F.explode(F.sequence(F.floor(lo / CELL), F.floor((lo + n - 1) / CELL))))
    p = paths(runs)
    p = cells(p, F.col("lo"), F.col("hi") - F.col("lo"))
    r = cells(runs, F.col("src_start"), F.col("n"))
    j = r.join(p, (r["src_doc"] == p["doc"]) & (r["_cell"] == p["_cell"]))
    lo, hi = F.greatest("src_start", "lo"), F.least(F.col("src_start") + F.col("n"), F.col("hi"))
    # both lie in all the cells that they share: the first of these counts
    j = j.filter((lo < hi) & (F.floor(lo / CELL) == r["_cell"]))
    return j.select("doc_id", (F.col("start") + lo - F.col("src_start")).alias("start"), (hi - lo + (k - 1)).alias("n_words"), "src_doc", lo.alias("src_start"), "path")


def op4_debruijn(spark, sf_dir: str) -> DataFrame:
    """Rows of one id are documents in the order of their texts' hashes; rows without an id come last."""
    d = Documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    got = d.without_verified(debruijn_repeats(d.texts), 20, digest=True)
    return got.select("doc.doc_id", "n_words", "n_removed", F.col("out").alias("kept_sha256"))
