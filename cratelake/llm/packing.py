"""Operator 5: packing token pieces into sequences by a linear grouping scheme."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratelake.llm.common import ranked, staged

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


#: Fixed value: how a byte-level BPE file with the usual pre-tokeniser cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The encoding of a byte-level BPE file of library ``tokenizers``, kept for a worker's life.

    The file's vocabulary is handed to ``tiktoken``, which gives the same ids several times faster:
    merges rank as their ids do. Bytes that aren't printable stand in the file as the code points
    from 256 on.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in t): i for t, i in tok.get_vocab(with_added_tokens=False).items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _cut(path: str | None, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = _encoder(path or public_tokenizers.path("byte_bpe_50k.json")).encode_to_numpy
        tail = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                texts = [t or "" for t in b.column("text").to_pylist()]
                cols: list[list] = [[] for _ in range(5 + with_ids)]
                for doc, text in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                    ids = encode(text, allowed_special="all").astype("<u4").tobytes() + tail
                    n = len(ids) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                        part = ids[4 * x : 4 * y]
                        row = [doc, i, x, y - x, zlib.crc32(part)]
                        for c, v in zip(cols, [*row, np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else row, strict=True):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of each document's token ids and a closing ``end_id``: one, or if that is longer
    than ``capacity`` a first of what is left over and full ones.

    Null texts count as empty; a row that is repeated is cut, and later packed, as often as it
    comes; ``tokenizer`` is a file every worker can read (unset: the installed public byte BPE).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def _fill(room: int, sizes: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Indices and numbers of pieces of the given sizes that fill ``room`` best (a subset sum)."""
    reach = np.full(room + 1, -1, np.int32)  # size index last used to get here
    reach[0] = len(sizes)
    used = np.zeros(room + 1, np.int32)
    for i, (s, c) in enumerate(zip(sizes, counts, strict=True)):
        if not c or s > room:
            continue
        used[:] = 0
        for x in range(s, room + 1):
            if reach[x] < 0 and reach[x - s] >= 0 and used[x - s] < c:
                reach[x], used[x] = i, used[x - s] + 1
    x = int(np.flatnonzero(reach >= 0)[-1])
    out: dict[int, int] = {}
    while x:
        i = int(reach[x])
        out[i] = out.get(i, 0) + 1
        x -= sizes[i]
    return list(out.items())


def _dearest(room: int, sizes: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """How many pieces of each size fill ``room`` at the highest total price (an unbounded knapsack). Fillings up to the
    least size more than those known follow from these, so that many are found at once."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    step = int(sizes.min())
    for lo in range(step, room + 1, step):
        at = np.arange(lo, min(lo + step, room + 1))
        before = at[:, None] - sizes
        worth = np.where(before >= 0, best[np.maximum(before, 0)] + prices, -1.0)
        pick = worth.argmax(axis=1)
        top, left = worth[np.arange(len(at)), pick], best[lo - 1]
        use = top > np.maximum(left, 0)
        best[at], last[at] = np.where(use, top, left), np.where(use, pick, -1)
        # a larger room holds what a smaller one does
        best[at] = np.maximum.accumulate(best[at])
    out, x = np.zeros(len(sizes), np.int64), room
    while x >= step:
        if last[x] < 0 or x and best[x - 1] >= best[x]:
            x -= 1
            continue
        out[last[x]] += 1
        x -= int(sizes[last[x]])
    return out


def _mix(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each, in fractions, for the fewest bins over all sizes together: the
    linear relaxation of cutting stock, a pattern at a time brought in that is worth more than a bin at the prices
    that the present ones set. It ends when none is worth ``1 + gap``, which bounds the excess, or after ``rounds``;
    the patterns hold all pieces at any time."""
    patterns = np.diag((capacity // sizes).astype(float))
    inverse, times = np.diag(1 / np.diag(patterns)), counts / np.diag(patterns)
    for i in range(1, rounds + 1):
        prices = inverse.sum(axis=0)
        column = _dearest(capacity, sizes, prices)
        if prices @ column <= 1 + gap:
            break
        swap = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(swap > 1e-9, times / np.where(swap > 1e-9, swap, 1), np.inf)
        out = int(ratio.argmin())
        times = np.maximum(times - ratio[out] * swap, 0)
        times[out], patterns[:, out] = ratio[out], column
        if i % 500:
            row = inverse[out] / swap[out]
            inverse -= np.outer(swap, row)
            inverse[out] = row
        else:  # what rounding has added up goes
            inverse = np.linalg.inv(patterns)
            times = np.maximum(inverse @ counts, 0)
    return np.rint(patterns).astype(np.int64), times


def _greedy(rounded: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns for what is left: the largest size, with the best filling of what room it leaves, as often as it goes."""
    left, out = list(counts), []
    for big in sorted(range(len(rounded)), key=lambda i: -rounded[i]):
        while left[big]:
            left[big] -= 1
            fill = dict(_fill(capacity - rounded[big], rounded, left))
            left[big] += 1
            fill[big] = fill.get(big, 0) + 1
            times = min(left[i] // c for i, c in fill.items())
            for i, c in fill.items():
                left[i] -= c * times
            out.append((times, sorted(fill.items(), key=lambda p: -rounded[p[0]])))
    return out


def configurations(rounded: list[int], counts: list[int], capacity: int, rounds: int = 4000, gap: float = 1e-3) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns over few sizes, each with how often it is used, until no piece is left.

    The fractions of ``_mix`` are rounded down, and what they leave, a few pieces of each size, is filled
    greedily; if that takes more bins than filling all of it greedily, the latter is returned.
    """
    plain = _greedy(rounded, counts, capacity)
    patterns, times = _mix(np.array(rounded), np.array(counts, float), capacity, rounds, gap)
    left, out = np.array(counts), []
    for p, t in zip(patterns.T, np.floor(times + 1e-6).astype(np.int64), strict=True):
        held = np.flatnonzero(p)
        if (t := min(t, (left[held] // p[held]).min())) > 0:
            left -= t * p
            out.append((int(t), [(int(i), int(p[i])) for i in sorted(held, key=lambda i: -rounded[i])]))
    out += _greedy(rounded, left.tolist(), capacity)
    return min(plain, out, key=lambda plan: sum(t for t, _ in plan))


def _best_fit(slack: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best fit by lengths, longest first, on counts alone.

    slack: how many open bins have so much room. Returns assignments (length, first rank, count,
    slack class, first bin of the class) and the number of new bins, class ``capacity + 1``.
    """
    queue: list[deque] = [deque() for _ in range(capacity + 1)]
    for s, n in slack.items():
        if s and n:
            queue[s].append((s, 0, n))
    new, out = 0, []
    for length in sorted(small, reverse=True):
        rank, left = 0, small[length]
        while left:
            s = next((s for s in range(length, capacity + 1) if queue[s]), None)
            if s is None:
                opened = -(-left // (capacity // length))
                queue[capacity].append((capacity + 1, new, opened))
                new += opened
                continue
            cls, at, n = queue[s].popleft()
            take = min(n, left)
            out.append((length, rank, take, cls, at))
            queue[s - length].append((cls, at, take))
            if take < n:
                queue[s].appendleft((cls, at + take, n - take))
            rank, left = rank + take, left - take
    return out, new


def pack(pieces: DataFrame, capacity: int = 1024, groups: int = 192, small: int = 96) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    Full pieces are a sequence each. The others longer than ``small`` are sorted by length and cut
    into ``groups`` of equal cardinality, each rounded up to its longest; configurations are
    optimised over these few sizes; real pieces take the places; the pieces up to ``small`` then
    go, longest first, where they leave the least room, by the real room. Only counts by length
    (at most ``capacity`` rows) are planned on the driver; which piece goes where follows from its
    rank among those of its length, by joins with the plan.
    """
    spark = pieces.sparkSession
    pieces = staged(pieces, "pieces")
    keys = ["doc_id", "piece"]
    rows = ranked(pieces, ["length"], keys, "rank")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = hist.get(capacity, 0)
    large = [n for n in sorted(hist, reverse=True) if small < n < capacity]
    total = sum(hist[n] for n in large)
    # lengths, longest first, with the number of pieces before each; a group is a stretch of ranks
    each, sizes, counts, cut, before = max(1, -(-total // groups)), [], [], [], 0
    base = {}
    for n in large:
        base[n] = before
        before += hist[n]
    for g in range(-(-total // each)):
        sizes.append(next(n for n in large if base[n] <= g * each < base[n] + hist[n]))
        counts.append(min(each, total - g * each))
        cut.append(g * each)
    slots, bins, taken = [], full, [0] * len(sizes)  # (first global rank, count, first bin, slot)
    for times, fill in configurations(sizes, counts, capacity) if total else []:
        slot = 0
        for g, c in fill:
            for _ in range(c):
                slots.append((cut[g] + taken[g], times, bins, slot))
                taken[g] += times
                slot += 1
        bins += times
    # every slot stretch crosses few lengths: cut it there, so that the join is on equality of length
    by_length = []
    for lo, count, first, slot in slots:
        for n in large:
            a, b = max(lo, base[n]), min(lo + count, base[n] + hist[n])
            if a < b:
                by_length.append((n, a - base[n], b - base[n], first + a - lo, slot))
    plan = F.broadcast(spark.createDataFrame(by_length or [(-1, 0, 0, 0, 0)], "length int, lo long, hi long, bin long, slot int"))
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    big = rows.filter(f"length > {small} AND length < {capacity}").join(plan, "length").filter(inside)
    big = big.select(*pieces.columns, (F.col("bin") + F.col("rank") - F.col("lo")).alias("sequence_id"), "slot")
    big = staged(big, "large")
    open_bins = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("slack"))
    open_bins = staged(ranked(open_bins, ["slack"], ["sequence_id"], "bin_rank"), "bins")
    slack = {r["slack"]: r["n"] for r in open_bins.groupBy("slack").agg(F.count("*").alias("n")).collect()}
    moves, new = _best_fit(slack, {n: c for n, c in hist.items() if n <= min(small, capacity - 1)}, capacity)
    fit = F.broadcast(spark.createDataFrame([(*m, i) for i, m in enumerate(moves)] or [(-1, 0, 0, 0, 0, 0)], "length int, lo long, take long, cls int, at long, step int"))
    little = rows.filter(f"length <= {min(small, capacity - 1)}").join(fit, "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("take")))
    little = little.select(*pieces.columns, "cls", (F.col("at") + F.col("rank") - F.col("lo")).alias("bin_rank"), (F.col("step") + 1000).alias("slot"))
    fresh = little.filter(F.col("cls") == capacity + 1).select(*pieces.columns, (F.col("bin_rank") + bins).alias("sequence_id"), "slot")
    filled = little.filter(F.col("cls") <= capacity).join(open_bins, (F.col("cls") == F.col("slack")) & (little["bin_rank"] == open_bins["bin_rank"]))
    filled = filled.select(*pieces.columns, "sequence_id", "slot")
    alone = rows.filter(F.col("length") == capacity).select(*pieces.columns, F.col("rank").alias("sequence_id"), F.lit(0).alias("slot"))
    shared = big.unionByName(filled).unionByName(fresh)
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return shared.withColumn("offset", offset).drop("slot").unionByName(alone.withColumn("offset", F.lit(0).cast("long")).drop("slot"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = pack(token_pieces(docs))
    return got.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
