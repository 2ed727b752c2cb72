"""Operator 10: a Merkle fixity audit of WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratelake.llm.common import staged


def records(pages: DataFrame, records_per_file: int = 1000) -> DataFrame:
    """WARC/1.0 resource records of (page_id, url, html): file, seq, page_id, record.

    A file holds a stretch of ids in their order. Null urls and bodies are empty; rows with a null
    id are left out, as they have no place in the order; repeated rows are records each; other
    columns are ignored.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return pages.filter("page_id IS NOT NULL").select(F.floor(F.col("page_id") / records_per_file).alias("file"), F.col("page_id").cast("long").alias("seq"), F.col("page_id").cast("long").alias("page_id"), record.alias("record"))


def leaves(recs: DataFrame) -> DataFrame:
    """(file, leaf, seq, page_id, offset, length, hash): records hashed where they are read; only lengths
    and hashes are shuffled, to find each record's number and offset in its file."""
    slim = recs.select("file", "seq", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    line = Window.partitionBy("file").orderBy("seq", "hash")
    offset = F.coalesce(F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slim.select("file", (F.row_number().over(line) - 1).cast("long").alias("leaf"), "seq", "page_id", offset.alias("offset"), "length", "hash")


def tree(leaf: DataFrame, fanout: int = 16, height: int = 3) -> DataFrame:
    """(file, level, node, offset, length, hash) of every level above the leaves, up to the root.

    A node stands for ``fanout`` consecutive ranges; its hash is that of their lengths and hashes in
    order, so a changed, missing, added or moved record changes every node above it.
    """
    level, out = leaf.select("file", F.col("leaf").alias("node"), "offset", "length", "hash"), None
    for k in range(1, height + 1):
        part = F.struct("node", F.concat_ws(":", "length", "hash").alias("x"))
        up = level.groupBy("file", F.floor(F.col("node") / fanout).alias("node") if k < height else F.lit(0).cast("long").alias("node"))
        level = up.agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["x"]), "\n"), 256).alias("hash"))
        named = level.select("file", F.lit(k).alias("level"), "node", "offset", "length", "hash")
        out = named if out is None else out.unionByName(named)
    return out


def _numbered(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("leaf")))


def _meet(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """a joined with b on keys of which null equals null; a column of each key remains."""
    b = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    met = a.join(b, on, how)
    if how == "left_semi":
        return met
    return met.withColumns({k: F.coalesce(k, f"_b_{k}") for k in keys}).drop(*[f"_b_{k}" for k in keys])


def audit(left: DataFrame, right: DataFrame, fanout: int = 16, height: int = 3) -> DataFrame:
    """Records in which two replicas (file, seq, page_id, record) differ: file, leaf, page_id, offset,
    length, status.

    The roots of each file are compared; then, level by level, only children of nodes that differ,
    and last the leaves below them. What lies under sound nodes is the same in both replicas, so the
    leaves under the others differ by just what the files differ by, wherever records have shifted
    to: they are matched by page and hash, copy by copy, and those left over by page, in turn.
    status: ``altered`` (both have the record, with other bytes), ``missing`` (only the left),
    ``added`` (only the right), ``moved`` (the same bytes at another place in the order). Differing
    roots give at least one row; equal or empty replicas give none. A null file is a file like any, and so is a
    null page, a page: its records are matched by their bytes, and those left over in their order.
    """
    a, b = staged(leaves(left), "left"), staged(leaves(right), "right")
    ta, tb = staged(tree(a, fanout, height), "tree"), staged(tree(b, fanout, height), "tree")
    bad = None
    for k in range(height, 0, -1):
        x, y = (t.filter(F.col("level") == k).select("file", "node", "hash") for t in (ta, tb))
        if bad is not None:
            down = bad.withColumnRenamed("node", "_up")
            x, y = (t.withColumn("_up", F.floor(F.col("node") / fanout) if k + 1 < height else F.lit(0).cast("long"))for t in (x, y))
            x, y = (_meet(t, down, ["file", "_up"], "left_semi").drop("_up") for t in (x, y))
        x, y = x.withColumnRenamed("hash", "_a"), y.withColumnRenamed("hash", "_b")
        bad = staged(_meet(x, y, ["file", "node"], "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", "node"), "bad")
    same, page = ["file", "page_id", "hash", "_copy"], ["file", "page_id", "_turn"]
    low = lambda t: _meet(t.withColumn("node", F.floor(F.col("leaf") / fanout)), bad, ["file", "node"], "left_semi").drop("node")
    la, lb = (_numbered(low(t), same[:-1], "_copy") for t in (a, b))
    named = lambda t, keys, p: t.select(*[F.col(c) if c in keys else F.col(c).alias(p + c) for c in t.columns])
    both = staged(_meet(named(la, same, "a_"), named(lb, same, "b_"), same, "full_outer"), "matched")
    moved = both.filter("a_seq <> b_seq").select("file", F.col("a_leaf").alias("leaf"), "page_id", F.col("a_offset").alias("offset"), F.col("a_length").alias("length"), F.lit("moved").alias("status"))
    rest = lambda p, o: _numbered(both.filter(F.col(o + "leaf").isNull()).select("file", "page_id", *[F.col(p + c).alias(c) for c in ("leaf", "offset", "length")]), ["file", "page_id"], "_turn")
    j = _meet(named(rest("a_", "b_"), page, "a_"), named(rest("b_", "a_"), page, "b_"), page, "full_outer")
    status = F.when(F.col("b_leaf").isNull(), "missing").when(F.col("a_leaf").isNull(), "added").otherwise("altered")
    pick = lambda c: F.coalesce(f"a_{c}", f"b_{c}").alias(c)
    return j.select("file", pick("leaf"), "page_id", pick("offset"), pick("length"), status.alias("status")).unionByName(moved)


def damaged(recs: DataFrame) -> DataFrame:
    """A replica with known damage: of every 97 pages one has a byte changed, one is cut short and
    one is gone, by their ids."""
    kind = F.pmod("page_id", F.lit(97))
    n = F.octet_length("record")
    flip = F.concat(F.substring("record", F.lit(1), n - 10), F.encode(F.lit("?"), "UTF-8"), F.substring("record", n - 8, F.lit(9)))
    record = F.when(kind == 13, flip).when(kind == 41, F.substring("record", F.lit(1), n - 7)).otherwise(F.col("record"))
    return recs.filter(kind != 77).withColumn("record", record)


def op10_fixity(spark, sf_dir: str) -> DataFrame:
    recs = records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = audit(recs, damaged(recs))
    return found.select(F.col("file").cast("long").alias("file"), "page_id", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), "status")


OP10_SQL = r"""
WITH r AS (
  SELECT page_id, floor(page_id / 1000)::BIGINT AS file,
         octet_length(encode(coalesce(html, ''))) AS body,
         octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
           || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
           || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ')) AS head
  FROM pages WHERE page_id IS NOT NULL),
s AS (SELECT page_id, file, (head + length(body::VARCHAR) + 4 + body + 4)::BIGINT AS length FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM s)
SELECT file, page_id, "offset", length,
       CASE page_id % 97 WHEN 77 THEN 'missing' ELSE 'altered' END AS status
FROM o WHERE page_id % 97 IN (13, 41, 77)
"""
