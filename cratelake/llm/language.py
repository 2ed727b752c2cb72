"""Operator 6: the languages of a document as a mixture, by expectation-maximisation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratelake.llm.documents import packed_row

#: Buckets that character trigrams are hashed to: with the number of languages this bounds the model.
BUCKETS = 1 << 15
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def _gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's trigrams (UTF-8 bytes of its letters, other ASCII as a space) and counts."""
    raw = text.lower().encode("utf-8", "replace").translate(_ASCII)
    b = np.frombuffer(b" ".join((b"", *raw.split(), b"")), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    c = np.bincount(x >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(c)
    return at, c[at].astype(np.float64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}

    def out():
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            at, c = _gram_counts(text)
            if lang not in seen:
                if len(seen) >= 64:
                    yield from out()
                    seen.clear()
                seen[lang] = np.zeros(BUCKETS, np.int64)
            seen[lang][at] += c.astype(np.int64)
    yield from out()


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # languages x buckets
    penalty: float

    def __post_init__(self):
        #: The mean log-likelihood of a trigram of each language under it.
        self.usual = (np.exp(self.log_p) * self.log_p).sum(axis=1)

    def infer(self, text: str) -> tuple[str, float, dict[str, float], float]:
        """The main language, its score, the proportions of the chosen set and the surprise: how many
        nats a trigram of the text is less likely under its mixture than one of the mixture's own."""
        if not self.langs or not _LETTER.search(text):
            return "und", 0.0, {}, 0.0
        at, c = _gram_counts(text)
        log_p = self.log_p[:, at]
        single = log_p @ c
        best = int(single.argmax())
        chosen, share, value = [best], np.ones(1), single[best]
        p = np.exp(log_p)
        n, cost = c.sum(), self.penalty * np.log(c.sum() + 1)
        while len(chosen) < len(self.langs):
            q = share @ p[chosen]
            slope = p @ (c / q) / n  # a language helps just if this is over 1
            slope[chosen] = 0
            new = int(slope.argmax())
            if slope[new] <= 1:
                break
            trial = [*chosen, new]
            pi = np.append(share * 0.9, 0.1)
            for _ in range(12):
                q = pi @ p[trial]
                pi = pi * (p[trial] @ (c / q)) / n
            got = c @ np.log(pi @ p[trial])
            if got - value <= cost:
                break
            chosen, share, value = trial, pi, got
        top = int(share.argmax())
        if len(chosen) == 1:  # trigrams overlap by two thirds
            z = (single - single.max()) / 3
            score = 1 / np.exp(z).sum()
        else:
            score = share[top]
        usual = float(share @ self.usual[chosen])
        return self.langs[chosen[top]], float(min(1.0, max(0.0, score))), {self.langs[i]: float(s) for i, s in zip(chosen, share, strict=True)}, float(usual - value / n)


def fit(labelled: DataFrame, penalty: float = 4.0) -> Model:
    """Trigram likelihoods of each language, from all rows (text, lang) without a null.

    What reaches the driver is a count for each language and bucket, whatever the table's size.
    """
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    c = np.full((len(langs), BUCKETS), 0.1)
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        c[[place[x] for x in names], counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    return Model(langs, np.log(c / c.sum(axis=1, keepdims=True)) if langs else c, penalty)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, text, lang_pred, score from 0 to 1, mixture, surprise): doc holds the other columns of
    ``docs``, whatever their names; mixture is a map of the chosen languages' proportions.

    For each document expectation-maximisation gives the proportions of a set of languages; the set
    grows while the log-likelihood gains more than the penalty for one more. ``surprise`` tells a
    text of no known language, whose trigrams are much rarer in the mixture than its own.
    ``und`` (score and surprise 0, empty mixture) if the text is null or has no letter, or if nothing was
    learnt. Only the text is read, all of it. Repeated rows get equal results; an empty table gives
    an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kinds = [pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.float64()]
        for b in batches:
            got = [m.infer(t or "") for t in b.column("text").to_pylist()]
            new = [pa.array([list(g[i].items()) if i == 2 else g[i] for g in got], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text"), *new], ["doc", "text", "lang_pred", "score", "mixture", "surprise"])

    rows = docs.select(packed_row(docs), F.col("text").cast("string").alias("text"))
    out = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, mixture map<string,double>, surprise double").fields])
    return rows.mapInArrow(run, out)


def held_out(doc_id="doc_id"):
    """Rows that nothing is learnt from; a row without an id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    got = detect(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return got.select("doc.doc_id", "doc.held_out", "lang_pred", "score", "mixture", "surprise")
