"""Operator 9: a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratelake.llm.common import staged

#: Statistics of a text, before the transform.
STATS = ("n_words", "word_length", "symbols", "upper", "bang", "digits", "points", "repeats", "distinct", "lines", "non_ascii")
_SYMBOLS, _UPPER, _LOWER = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _POINTS = b"0123456789", b".,;:?'\"()-"


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logarithms of counts, logits of shares."""
    raw = text.encode("utf-8", "replace")
    ws = raw.split()
    n, size = len(ws), max(1, len(raw))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    share = lambda x, of: float(np.log((x + 0.5) / (of - x + 0.5)))
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    solid = sum(map(len, ws))
    return [
        float(np.log1p(n)), float(np.log1p(solid / max(1, n))), share(count(_SYMBOLS), size), share(upper, upper + lower), share(count(b"!"), size), share(count(_DIGITS), size),
        share(count(_POINTS), size), share(same, max(1, n)), float(np.log((len(set(ws)) + 0.5) / (n + 1))), share(len(lines) - len(set(lines)), max(1, len(lines))),
        share(count(bytes(range(128, 256))), size),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of each text; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunken covariances, log-determinants and log-priors."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    temper: float

    def __post_init__(self):
        #: The inverse of each triangular factor, by forward substitution, once for all batches.
        self.inverse = np.zeros_like(self.factor)
        for k in (0, 1):
            for i in range(len(STATS)):
                row = np.eye(len(STATS))[i] - self.factor[k, i, :i] @ self.inverse[k, :i]
                self.inverse[k, i] = row / self.factor[k, i, i]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        value = []
        for k in (0, 1):
            z = self.inverse[k] @ (x - self.mean[k]).T
            value.append(self.log_prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(axis=0)))
        return (value[1] - value[0]) / self.temper

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.05, temper: float = 2.0) -> Discriminant | None:
    """Learn from rows (x, quality in 0 or 1); None without rows of both classes.

    Only counts, sums and sums of products of each class reach the driver. Each class's covariance
    is drawn by ``shrink`` to the pooled one's diagonal, plus ``ridge``. The log-odds are divided by
    ``temper``, as the statistics aren't quite normal and their odds come out too sure.
    """
    d = len(STATS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    x = [F.col("x")[i] for i in range(d)]
    rows = labelled.filter("quality IN (0, 1)").groupBy("quality").agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")
    ).collect()
    by = {r["quality"]: r for r in rows}
    if set(by) != {0, 1}:
        return None
    n = np.array([by[k]["n"] for k in (0, 1)], float)
    mean = np.array([by[k]["s"] for k in (0, 1)]) / n[:, None]
    cov = np.zeros((2, d, d))
    for k in (0, 1):
        for (i, j), v in zip(pairs, by[k]["p"], strict=True):
            cov[k, i, j] = cov[k, j, i] = v / n[k] - mean[k, i] * mean[k, j]
    pooled = np.diag((cov * n[:, None, None]).sum(axis=0).diagonal() / n.sum())
    cov = (1 - shrink) * cov + shrink * pooled + ridge * np.eye(d)
    factor = np.linalg.cholesky(cov)
    log_det = 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(mean, factor, log_det, np.log(n / n.sum()), temper)


def scored(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) of measured rows: the probability of label 1; 0.5 where nothing was learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.array(b.column("x").to_pylist())
                s = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Nulls and empty texts are scored as empty; a document with several labels counts with each;
    labels other than 0 and 1 are left out; only the text is an input of a score, all of it. Repeated
    rows each get a row; a row without an id counts as not held out; other columns are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    stats = staged(measured(docs), "stats")
    model = fit(stats.join(labels.filter(~out), "doc_id"))
    return scored(stats, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
