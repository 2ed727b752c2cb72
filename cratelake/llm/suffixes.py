"""Operator 3: repeated passages by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratelake.llm.common import staged
from cratelake.llm.documents import Documents, compact
from cratelake.llm.wordspans import SPANS, cut_words, diagonals, grams, mix, slices, sliding_min, word_hashes

#: Suffixes of one key up to which they are sorted and compared in one group of a task.
HOT = 20_000
#: Keys up to which they are broadcast: 16 MB.
BROADCAST = 1_000_000
#: Rows that a task sorts at a time.
CHUNK = 20_000
#: Words up to which a match is extended in one round, and of which a task returns the hashes at a time.
FAR, ASKED = 4096, 1 << 20
ROWS = "key long, more long, doc_id long, pos int, around binary, n int, src_doc long, src_start int"
PLACES = "key long, left long, right long, doc_id long, pos int"
#: How a suffix is dealt, for the windows that begin before it on its left half and for those on the right: by its key, by
#: its key and the nearer half of the words on that side, or by each window.
KEY, HALF, WINDOW = 0, 1, 2
_Q = np.uint64(0xD1342543DE82EF95)


def _suffix_positions(h: np.ndarray, d: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers, the least ``k``-word grams (all, if several are equal) of a window of
    ``width`` words of one document, and the hashes of their grams."""
    g, reach = grams(h, k), width - k
    if len(h) < width:
        return np.zeros(0, np.int64), g[:0]
    low = np.where(d[: len(d) - width + 1] == d[width - 1 :], sliding_min(g, reach + 1), np.uint64(0))
    # a gram is a minimiser if it is the least of some window that holds it: of the greatest of their minima
    pad = np.full(reach, ~np.uint64(0))
    most = ~sliding_min(np.concatenate([pad, ~low, pad]), reach + 1)
    at = np.flatnonzero((g == most[: len(g)]) & (most[: len(g)] > 0))
    return at, g[at]


def _halves(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each suffix's gram with the words of half a reach before it, and with those after it: every window has one of
    the two. 0 where the document has no such words."""
    half, n = reach // 2, len(h)
    before, after = grams(h, half) if half else h[:0], grams(h, reach - half)
    pick = lambda g, i, ok: np.where(ok, mix(key ^ mix(g[np.clip(i, 0, max(0, len(g) - 1))])) | np.uint64(1), np.uint64(0)) if len(g) else np.zeros(len(at), np.uint64)
    left = pick(before, at - half, at - half >= lo)
    right = pick(after, at + k, (at + k + reach - half <= hi) & (at + k + reach - half <= n))
    return left, np.where(right > 0, right ^ np.uint64(2), right)


def _positions(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                s, e, d = cut_words(data, off)
                h = word_hashes(data, s, e)
                at, key = _suffix_positions(h, d, width, k)
                begin = np.searchsorted(d, np.arange(len(off)), "left")
                left, right = _halves(h, at, begin[d[at]], begin[d[at] + 1], key, k, width - k)
                ids = part.column("doc_id").take(pa.array(d[at]))
                cols = [*[pa.array(x.view(np.int64)) for x in (key, left, right)], ids, pa.array((at - begin[d[at]]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "left", "right", "doc_id", "pos"])

    return run


def _around(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, k: int, reach: int) -> np.ndarray:
    """The words after each suffix's gram, in order, then those before it, nearest first: 32 bits of
    their hashes, 0 beyond the document."""
    x = np.maximum(h.astype(np.uint32), 1)
    step = np.concatenate([np.arange(k, k + reach), np.arange(-1, -reach - 1, -1)])
    idx = at[:, None] + step
    inside = (idx >= lo[:, None]) & (idx < hi[:, None])
    return np.where(inside, x[np.clip(idx, 0, len(x) - 1)], 0)


def _suffixes(width: int, k: int):
    """The retained suffixes of each document with the words around them, dealt as ``_at`` says: ``more`` is 0 for all
    windows, 1 for those on the left half, 2 for those on the right; or a row for each window that a suffix stands in."""
    reach = width - k

    def rows(key, more, doc, pos, around, n_src=None) -> pa.RecordBatch:
        n = len(key)
        binary = pa.Array.from_buffers(pa.binary(8 * reach), n, [None, pa.py_buffer(around.astype(">u4").tobytes())]).cast(pa.binary()) if around is not None else pa.nulls(n, pa.binary())
        cols = [pa.array(key.view(np.int64)), pa.array(more.view(np.int64)), pa.array(doc, pa.int64()), pa.array(pos.astype(np.int32)), binary]
        cols += [pa.array(x, t) if x is not None else pa.nulls(n, t) for x, t in zip(n_src or (None,) * 3, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays(cols, ["key", "more", "doc_id", "pos", "around", "n", "src_doc", "src_start"])

    def windows(start, h, d, begin, ids) -> Iterator[pa.RecordBatch]:
        """The windows at these words, those that repeat in one document as runs that are known already."""
        win, other, doc, place = grams(h, width)[start], grams(mix(h), width)[start], ids[d[start]], start - begin[d[start]]
        order = np.lexsort((start, win, d[start]))
        a, b = order[:-1], order[1:]
        again = (win[a] == win[b]) & (other[a] == other[b]) & (d[start[a]] == d[start[b]])
        lead, row = a[again], b[again]
        back = np.argsort(start[row], kind="stable")
        x = diagonals(doc[row][back], place[row][back], doc[lead][back], place[lead][back])
        if len(x["doc_id"]):
            yield rows(mix(x["doc_id"].view(np.uint64)), np.zeros(len(x["doc_id"]), np.uint64), x["doc_id"], x["start"], None, (x["n"].astype(np.int32), x["src_doc"], x["src_start"].astype(np.int32)))
        first = np.ones(len(start), bool)
        first[row] = False
        yield rows(win[first], other[first], doc[first], place[first], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                s, e, d = cut_words(data, off)
                h = word_hashes(data, s, e)
                begin = np.searchsorted(d, np.arange(len(off)), "left")
                wanted = part.column("_at")
                of = np.repeat(np.arange(len(part)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
                flat = wanted.flatten()
                pos, by = flat.field("pos").to_numpy().astype(np.int64), [flat.field(x).to_numpy() for x in ("l", "r")]
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                at, g = pos + begin[of], grams(h, k)
                lo, hi, half = begin[of], begin[of + 1], reach // 2
                sides = _halves(h, at, lo, hi, g[at], k, reach)
                for more, some in ((0, by[0] == KEY), (1, by[0] == HALF), (2, by[1] == HALF)):
                    key = sides[more - 1] if more else g[at]
                    some &= key != 0 if more else True
                    if some.any():
                        a = at[some]
                        yield rows(key[some], np.full(len(a), more, np.uint64), ids[of[some]], pos[some], _around(h, lo[some], hi[some], a, k, reach))
                # a window begins ``o`` words before its suffix: half or more on the left side, less on the right one
                starts = []
                for some, least, most in ((by[0] == WINDOW, half, reach), (by[1] == WINDOW, 0, half - 1)):
                    first = np.maximum(at[some] - most, lo[some])
                    n = np.maximum(0, np.minimum(at[some] - least, hi[some] - width) - first + 1)
                    starts.append(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                if len(start := np.unique(np.concatenate(starts))):
                    yield from windows(start, h, d, begin, ids)

    return run


def _compare(rows: dict[str, np.ndarray], reach: int) -> dict[str, np.ndarray]:
    """Spans of windows that also start earlier, of suffixes sorted by key and following words.

    Neighbours share a prefix; a suffix's window that begins ``o`` words before it is one of the block
    of suffixes that share ``reach - o`` following words, and of those that also share the ``o`` words
    before it the last one with an earlier place is matched. So each suffix is extended to the left
    and right along the nearest earlier ones with which it shares a window; in a text that repeats a
    phrase over and over these follow one another too.
    """
    key, more, doc, pos, around = rows["key"], rows["more"], rows["doc_id"], rows["pos"], rows["around"]
    n, after, before = len(key), rows["around"][:, :reach], around[:, reach:]
    same = np.zeros((n, reach), bool)
    same[1:] = (after[1:] == after[:-1]) & (after[1:] > 0)
    shared = np.where(same.all(axis=1), reach, (~same).argmax(axis=1))
    other = np.ones(n, bool)
    other[1:] = key[1:] != key[:-1]
    by_place = np.lexsort((pos, doc))
    left, out = np.zeros(n, np.uint64), []
    for o in range(reach + 1):
        if o:
            left = mix(left * _Q + before[:, o - 1].astype(np.uint64) + np.uint64(1))
        ok = (before[:, o - 1] > 0 if o else np.ones(n, bool)) & (after[:, reach - o - 1] > 0 if o < reach else True)
        ok &= more != (2 if o >= reach // 2 else 1)
        block = np.cumsum(other | (shared < reach - o)).astype(np.uint64)
        at = by_place[ok[by_place]]
        tag = (mix(block * _Q) ^ left)[at]
        order = np.argsort(tag, kind="stable")
        again = np.flatnonzero(tag[order[1:]] == tag[order[:-1]])
        out.append((at[order[again + 1]], at[order[again]], np.full(len(again), o)))
    row, lead, o = (np.concatenate(x) for x in zip(*out, strict=True))
    doc, start, src_doc, src_start = doc[row], pos[row] - o, doc[lead], pos[lead] - o
    order = np.lexsort((start, doc))
    # a window that holds several of the suffixes is found with each of them
    new = np.ones(len(order), bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (start[order[1:]] != start[order[:-1]])
    return diagonals(*[x[order[new]] for x in (doc, start, src_doc, src_start)])


def _spans(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int32(), "n": pa.int32(), "src_doc": pa.int64(), "src_start": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(x[c], k) for c, k in kinds.items()], list(kinds))


def _neighbours(reach: int):
    """Rows come sorted by key, following words and place. Those of one key are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        last = None  # hashes and place of the last window

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            # of the last key more rows may come
            n, whole = len(rows["key"]), np.flatnonzero(rows["key"] != rows["key"][-1])
            end = n if last else int(whole[-1]) + 1 if len(whole) else 0
            held[:] = [{c: x[end:] for c, x in rows.items()}] if end < n else []
            if end:
                yield _spans(_compare({c: x[:end] for c, x in rows.items()}, reach))

        for b in batches:
            through = pc.is_valid(b.column("n"))
            if (plain := b.filter(through)).num_rows:
                yield plain.select(["doc_id", "pos", "n", "src_doc", "src_start"]).rename_columns(["doc_id", "start", "n", "src_doc", "src_start"])
            b = b.filter(pc.invert(through))
            known = pc.is_valid(b.column("around"))
            alone, b = b.filter(pc.invert(known)), b.filter(known)
            if len(alone):
                k, m, doc, pos = (alone.column(c).to_numpy() for c in ("key", "more", "doc_id", "pos"))
                if last is not None:
                    k, m, doc, pos = (np.concatenate([[x], y]) for x, y in zip(last, (k, m, doc, pos), strict=True))
                lead = np.arange(len(k)) - 1
                again = np.append(False, (k[1:] == k[:-1]) & (m[1:] == m[:-1]) & ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))
                last = tuple(x[-1] for x in (k, m, doc, pos))
                order = np.lexsort((pos[again], doc[again]))
                yield _spans(diagonals(*[x[order] for x in (doc[again], pos[again].astype(np.int64), doc[lead[again]], pos[lead[again]].astype(np.int64))]))
            if len(b):
                around = b.column("around")
                raw = np.frombuffer(around.buffers()[2], np.uint8)[: (around.offset + len(b)) * 8 * reach][around.offset * 8 * reach :]
                held.append({
                    "key": b.column("key").to_numpy(), "more": b.column("more").to_numpy(), "doc_id": b.column("doc_id").to_numpy(), "pos": b.column("pos").to_numpy().astype(np.int64),
                    "around": raw.view(">u4").reshape(len(b), 2 * reach).astype(np.uint32),
                })
                if sum(len(x["key"]) for x in held) >= CHUNK:
                    yield from ready(False)
        if held:
            yield from ready(True)

    return run


def repeated_windows(texts: DataFrame, width: int, k: int, hot: int = HOT) -> DataFrame:
    """(doc_id, start, n, src_doc, src_start): windows start .. start+n-1 of doc_id equal windows
    src_start .. of src_doc, which come before them in the order of (doc_id, start). Every window of
    ``width`` words with an earlier equal is in some row. ``texts`` (doc_id, text) has an id once.

    1. Of all suffixes those at minimiser positions are retained, some 2 of ``width - k + 2``, and of
    them those whose ``k``-word gram stands more than once. 2. These are taken from their texts with the
    ``width - k`` words after and before them, as 32-bit hashes. 3. They are dealt by key, sorted by
    what follows, and compared. Suffixes of a key that stands over ``hot`` times are dealt twice instead, by
    the half of the words before them and by that of the words after them, as every window holds one of
    the two; and where even that stands over ``hot`` times by each of the windows, of which those that are equal meet alone. Windows are equal by 64
    bits of their gram's hash and 32 of each other word's.
    """
    places = staged(texts.mapInArrow(_positions(width, k), PLACES), "places")
    often = lambda t, c: staged(t.groupBy(c).agg(F.count("*").alias("_n")).filter("_n > 1"), "keys")
    keys, at = often(places, "key"), lambda left, right: F.struct("pos", left.alias("l"), right.alias("r")).alias("_at")
    if keys.count() <= BROADCAST:
        found = places.join(F.broadcast(keys), "key")
        cold, top = found.filter(F.col("_n") <= hot), found.filter(F.col("_n") > hot)
    else:
        # hot keys stand for over ``hot`` suffixes each, so they are few; their places aren't dealt by key, as those of the others are
        many, rest = keys.filter(F.col("_n") > hot), keys.filter(F.col("_n") <= hot)
        many = F.broadcast(many) if many.count() <= BROADCAST else many
        top, cold = places.join(many, "key"), places.join(many, "key", "left_anti").join(rest, "key")
    kept = cold.select("doc_id", at(F.lit(KEY), F.lit(KEY)))
    if not keys.filter(F.col("_n") > hot).isEmpty():
        top = staged(top.select("doc_id", "pos", "left", "right"), "hot")
        for side in ("left", "right"):
            n = often(top.filter(F.col(side) != 0), side).withColumnsRenamed({"_n": f"_{side}"})
            top = top.join(F.broadcast(n) if n.count() <= BROADCAST else n, side, "left")
        how = lambda c: F.when(F.col(c).isNull(), -1).when(F.col(c) <= hot, HALF).otherwise(WINDOW)
        kept = kept.unionByName(top.filter("_left IS NOT NULL OR _right IS NOT NULL").select("doc_id", at(how("_left"), how("_right"))))
    kept = kept.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("_at").alias("_at"))
    rows = texts.join(kept.hint("shuffle_hash"), texts["doc_id"] == kept["_id"]).drop("_id").mapInArrow(_suffixes(width, k), ROWS)
    dealt = rows.repartition("key").sortWithinPartitions("key", "around", "more", "doc_id", "pos")
    return dealt.mapInArrow(_neighbours(width - k), SPANS)


def _beside(reach: int):
    """The hashes of up to ``reach`` words after or before each of the asked places of a document, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                s, e, d = cut_words(data, off)
                h = word_hashes(data, s, e).view(np.int64)
                begin = np.searchsorted(d, np.arange(len(off)), "left")
                wanted = part.column("_ends")
                of = np.repeat(np.arange(len(part)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
                flat, ids = wanted.flatten(), part.column("doc_id")
                at, after = flat.field("at").to_numpy().astype(np.int64), flat.field("after").to_numpy(zero_copy_only=False)
                n = np.minimum(reach, np.where(after, begin[of + 1] - begin[of] - at, at))
                # as many places at a time as ask for some ASKED words
                cuts = np.flatnonzero(np.diff(np.cumsum(n) // ASKED)) + 1
                for some in np.split(np.arange(len(n)), cuts):
                    edges = np.concatenate([[0], np.cumsum(n[some])])
                    row = np.repeat(some, n[some])
                    step = np.arange(len(row)) - np.repeat(edges[:-1], n[some])
                    word = begin[of[row]] + np.where(after[row], at[row] + step, at[row] - 1 - step)
                    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(h[word]))
                    cols = [ids.take(pa.array(of[some])), pa.array(at[some].astype(np.int32)), pa.array(after[some]), lists]
                    yield pa.RecordBatch.from_arrays(cols, ["doc", "at", "after", "near"])

    return run


def _agreeing(own: str, other: str) -> Column:
    """How many words two lists begin with alike; none where one is missing."""
    differs = F.array_position(F.zip_with(own, other, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(F.col(own).isNull() | F.col(other).isNull(), 0).when(differs > 0, differs - 1).otherwise(F.size(own)).cast("int")


def extended(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (doc_id, start, n_words, src_doc, src_start) word by word to the left and right at their own
    coordinates, until the words differ or a document ends; those that become one are one row.

    One word on each side is compared first; spans that agree there go on with 8 times as many, up to ``FAR`` at a
    time. Each place of a document is read once a round, however many spans end there.
    """
    going, done, reach = spans.select("doc_id", "start", "n_words", "src_doc", "src_start", F.lit(True).alias("_left"), F.lit(True).alias("_right")), [], 1
    while True:
        going = staged(going, "spans")
        if done and going.isEmpty():
            break
        places = [("doc_id", F.col("start"), False, "_left"), ("src_doc", F.col("src_start"), False, "_left")]
        places += [("doc_id", F.col("start") + F.col("n_words"), True, "_right"), ("src_doc", F.col("src_start") + F.col("n_words"), True, "_right")]
        ends = [F.when(F.col(on), F.struct(F.col(doc).alias("_id"), at.cast("int").alias("at"), F.lit(after).alias("after"))) for doc, at, after, on in places]
        asked = going.select(F.explode(F.filter(F.array(*ends), lambda x: x.isNotNull())).alias("x"))
        asked = asked.groupBy("x._id").agg(F.collect_set(F.struct("x.at", "x.after")).alias("_ends"))
        found = texts.join(asked.hint("shuffle_hash"), texts["doc_id"] == asked["_id"]).drop("_id")
        beside = staged(found.mapInArrow(_beside(reach), "doc long, at int, after boolean, near array<long>"), "beside")
        for i, (doc, at, after, on) in enumerate(places):
            near = beside.filter(F.col("after") == after).select(F.col("doc").alias("_doc"), F.col("at").alias("_at"), F.col("near").alias(f"_near{i}"))
            going = going.join(near, F.col(on) & (F.col(doc) == F.col("_doc")) & (at == F.col("_at")), "left").drop("_doc", "_at")
        left, right = F.col("_before"), F.col("_after")
        going = staged(going.withColumns({"_before": _agreeing("_near0", "_near1"), "_after": _agreeing("_near2", "_near3")}).select(
            "doc_id", (F.col("start") - left).alias("start"), (F.col("n_words") + left + right).alias("n_words"), "src_doc", (F.col("src_start") - left).alias("src_start"),
            (left == reach).alias("_left"), (right == reach).alias("_right"),
        ), "extended")
        done.append(going.filter("NOT _left AND NOT _right").drop("_left", "_right"))
        going = going.filter("_left OR _right")
        reach = min(8 * reach, FAR)
    return reduce(DataFrame.unionByName, done).distinct()


def sparse_suffix_repeats(docs: DataFrame, min_words: int = 50, k: int = 16) -> DataFrame:
    """Passages of at least ``min_words`` words that also start earlier: (doc_id, start, n_words,
    match_doc_id, match_start), in words. Each match is extended to the left and right, word by word, as
    far as both of its places agree, so that no row could be longer where it stands; where several earlier
    places agree with different parts of a passage, there is a row for each, and these may overlap.

    Null and blank texts give no rows; documents come in the order of doc_id, null last, and rows of one
    id in that of their texts' hashes; of equal texts all but the first are repeated; an empty table
    gives an empty result; other columns are ignored.
    """
    d = Documents(docs.select("doc_id", "text"))
    m = compact(repeated_windows(d.texts, min_words, k)).withColumn("n_words", F.col("n") + (min_words - 1))
    return d.named(extended(d.texts, m), min_words)


def op3_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return sparse_suffix_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
