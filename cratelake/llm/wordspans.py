"""Words of many texts at once, their hashes, and runs of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time in a task; what is computed of them takes some 60 times as much.
SLICE = 1 << 20

SPANS = "doc_id long, start int, n int, src_doc long, src_start int"

_B, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    if base not in _pow or len(_pow[base][0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _pow[base] = tuple(out)
    return _pow[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the number of the document of each."""
    n = len(data)
    solid = ~_WS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    pw, inv = _powers(_B, len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=c[1:])
    return mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    pw, inv = _powers(_Q, len(h) + 1)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * pw[: len(h)], out=c[1:])
    return mix((c[k:] - c[:-k]) * inv[: len(h) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - span : w - span + len(x) - w + 1])


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of some SLICE bytes, with the text's bytes and each document's offset."""
    col = batch.column(batch.schema.get_field_index(text))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        j = min(j, len(col))
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def diagonals(doc, pos, src_doc, src_pos) -> dict[str, np.ndarray]:
    """Windows that follow one another both here and in their source make one span."""
    if not len(doc):
        return {"doc_id": doc, "start": pos, "n": pos, "src_doc": src_doc, "src_start": src_pos}
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (src_doc[1:] != src_doc[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)
    at = np.flatnonzero(new)
    return {"doc_id": doc[at], "start": pos[at], "n": np.diff(np.append(at, len(doc))), "src_doc": src_doc[at], "src_start": src_pos[at]}
