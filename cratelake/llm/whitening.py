"""Operator 12: whitening of embeddings with distributed block matrices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelake.llm.common import numbered, staged

#: Rows of a block of the row matrix; its width is that of the vectors, up to WIDE columns.
ROWS, WIDE = 1024, 1024
#: Blocks that one task of a scatter product multiplies and adds up.
BLOCKS = 8
#: An eigenvalue of no more than this share of the largest one is none: its component is left out.
RANK = 1e-12
#: Integer entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000


def entries(rows: DataFrame, vector: str, out: str) -> DataFrame:
    """Rows with ``out``, the vector in whole numbers; null and empty vectors and those with null or non-finite entries go, as do
    entries beyond +-2^52."""
    c = F.col(vector).cast("array<double>")
    good = F.forall(c, lambda x: F.coalesce(F.abs(x) < 2.0**52, F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(False)))
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(good)
    return kept.withColumn(out, F.transform(c, lambda x: F.floor(x * SCALE).cast("long") + SHIFT))


def _blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """The block matrix of rows (i, v), i from 0 to n - 1."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("i"), array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(ROWS, min(width, WIDE))


def _times(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a x b, the inner dimension cut into so many tasks a result block."""
    got = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(got, a.rowsPerBlock, b.colsPerBlock)


def _scatter(m: BlockMatrix, n: int) -> np.ndarray:
    """m^T m, of which only this square is brought to the driver."""
    return _times(m.transpose(), m, max(1, math.ceil(n / ROWS / BLOCKS))).toLocalMatrix().toArray()


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and their unit eigenvectors as columns, without those of rank zero;
    the entry of a vector that is largest in size is positive."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2 / n)
    order = np.argsort(values)[::-1][:most]
    values, vectors = values[order], vectors[:, order]
    kept = values > max(RANK * values[0], 0) if len(values) else np.zeros(0, bool)
    values, vectors = values[kept], vectors[:, kept]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def whiten(rows: DataFrame, key: str, vector: str, most: int = 16) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row and each component up to ``most``.

    The fit list is each distinct integer vector once: equal rows neither weigh more nor are projected twice. Its
    centred rows are the blocks of a matrix; the transposed matrix times it is the scatter, whose square
    of dimensions (the only thing that meets on the driver, a few thousand dimensions at most) is
    decomposed there; the matrix times the whitening matrix projects the rows. A scatter product is cut
    along the rows, so that no task holds more than some blocks.

    Dropped: null and empty vectors, those with null or non-finite entries or entries beyond 2^52, and those of another length
    than most (of lengths equally common the least stays). Components of no variance are left out: a table whose
    vectors are all equal, or an empty one, gives no rows. ``deviation`` is null where it doesn't fit a long.
    Repeated rows and rows of one id give equal rows each; other columns are ignored.
    """
    spark, schema = rows.sparkSession, f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    all_of = staged(entries(rows.select(F.col(key), F.col(vector).alias("_v")), "_v", "x").select(key, "x"), "entries")
    lengths = all_of.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    all_of = all_of.filter(F.size("x") == d)
    fit = staged(numbered(all_of.select("x").distinct(), [F.xxhash64("x"), F.col("x")], "i"), "fit")
    n = fit.count()
    cells = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sums = sorted(cells.collect())  # a row a dimension
    total = [int(r["s"]) for r in sums]
    most_off = max(max(abs(n * r["lo"] - int(r["s"])), abs(n * r["hi"] - int(r["s"]))) for r in sums)
    # n x - S in whole numbers: longs where these are proven to hold it, else decimals
    whole = "long" if d * most_off**2 < 2**63 else "decimal(38,0)"
    sum_of = F.array(*[F.lit(str(s)).cast(whole) for s in total])
    off = F.zip_with(F.transform("x", lambda x: x.cast(whole) * F.lit(n).cast("long" if whole == "long" else "decimal(18,0)")), sum_of, lambda x, s: x - s)
    centred = staged(fit.withColumn("_off", off.cast(f"array<{whole}>")), "centred")
    v = F.transform("_off", lambda x: x.cast("double") / F.lit(float(n)))
    matrix = _blocks(centred.select("i", v.alias("v")), n, d)
    scatter = _scatter(matrix, n)
    values, vectors = components(scatter, n, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    k = len(values)
    weights = vectors / np.sqrt(values)
    narrow = [((i, 0), DenseMatrix(len(w), k, w.flatten(order="F"))) for i, w in enumerate(weights[a : a + WIDE] for a in range(0, d, WIDE))]
    whitening = BlockMatrix(spark.sparkContext.parallelize(narrow, 1), min(d, WIDE), k, d, k)
    projected = _times(matrix, whitening, 1).toIndexedRowMatrix()
    lines = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).toDF("i", "v")
    lines = staged(lines.select("i", vector_to_array("v").alias("w")), "projected")
    means = np.array([r["m"] for r in lines.select(F.posexplode("w").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("m")).orderBy("at").collect()])
    covariance = _scatter(_blocks(lines.select("i", F.col("w").alias("v")), n, k), n) / n - np.outer(means, means)
    error = float(np.abs(covariance - np.eye(k)).max())
    square = F.aggregate("_off", F.lit(0).cast(whole), lambda a, x: (a + x * x).cast(whole))
    named = centred.select("x", "i", (square if whole == "long" else square.try_cast("long")).alias("deviation")).join(lines, "i").drop("i")
    trace = float(np.trace(scatter) / n)
    out = all_of.join(named, "x").select(key, "deviation", F.posexplode("w").alias("_at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(e / trace)) for e in values]), F.col("_at"))
    return out.select(key, (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every row of ``embeddings``."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
