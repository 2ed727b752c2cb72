"""Tables of documents whose ids are once each, and what is cut out of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratelake.llm.common import numbered, staged, words
from cratelake.llm.wordspans import cut_words, slices

#: Words of a verified block. Blocks begin at multiples of it in the source, so that a document of n
#: words is asked for some 2 n different ones at most, however many others repeat it.
BLOCK = 128
_PROOF = "array<struct<own: boolean, start: int, doc: bigint, at: int, n: int, digest: binary>>"


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed_row(docs: DataFrame) -> Column:
    """All columns but the text as one, ``doc``."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")


def unpacked(df: DataFrame, columns: list[str], **new: str) -> DataFrame:
    """The columns as they were before ``packed_row``; those named in ``new`` from that column of ``df``."""
    return df.select(*[F.col(new[c]).alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in columns])


class Documents:
    """Rows (doc_id, text and others) as documents with an id each.

    ``rows`` is (doc_id, doc, text), doc holding the other columns as they came. If ids are null or repeated
    the documents are numbered instead, in the order of doc_id, null last, and then of a hash of the
    text; rows of one id and text are one document, and all but the first of them are in
    ``others`` (doc, text, more: how many), copies that stand after it. Names of columns don't matter.
    """

    def __init__(self, docs: DataFrame):
        packed = docs.select(packed_row(docs), F.col("text").cast("string").alias("text"))
        ids = docs.select("doc_id").groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
        self.renamed, self.others = None, None
        if ids.isEmpty():
            self.rows = packed.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "doc", "text")
        else:
            held = packed.groupBy("doc", "text").agg(F.count("*").alias("_n"))
            held = held.select("doc", "text", "_n", F.col("doc.doc_id").alias("_id"), text_key(F.col("text")).alias("_key"), F.xxhash64("doc").alias("_h"))
            held = staged(held, "held")
            lead = held.groupBy("_id", "_key").agg(F.min("_h").alias("_lead"))
            lead = staged(numbered(lead, [F.col("_id").asc_nulls_last(), F.col("_key")], "doc_id"), "numbers")
            self.renamed = lead.select(F.col("doc_id").alias("_of"), "_id")
            of = lead.withColumnsRenamed({"_id": "_i", "_key": "_k"})
            held = held.join(of, held["_id"].eqNullSafe(of["_i"]) & (held["_key"] == of["_k"]))
            first = F.col("_h") == F.col("_lead")
            self.rows = held.filter(first).select("doc_id", "doc", "text")
            self.others = held.select("doc", "text", (F.col("_n") - first.cast("long")).alias("more")).filter("more > 0")
        self.texts = self.rows.select("doc_id", "text")

    def named(self, spans: DataFrame, width: int) -> DataFrame:
        """Spans (doc_id, start, n_words, src_doc, src_start) with the ids as they came, and those of
        the others, each of which repeats its first from the first word to the last."""
        out = spans.select("doc_id", "start", "n_words", F.col("src_doc").alias("match_doc_id"), F.col("src_start").alias("match_start"))
        if self.renamed is None:
            return out
        a, b = self.renamed.withColumnsRenamed({"_id": "_a", "_of": "_x"}), self.renamed.withColumnsRenamed({"_id": "_b", "_of": "_y"})
        out = out.join(a, F.col("doc_id") == F.col("_x")).join(b, F.col("match_doc_id") == F.col("_y"))
        out = out.select(F.col("_a").cast("long").alias("doc_id"), "start", "n_words", F.col("_b").cast("long").alias("match_doc_id"), "match_start")
        whole = self.others.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.size(words(F.col("text"))).alias("n_words"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))))
        whole = whole.filter(F.col("n_words") >= width).select("doc_id", F.lit(0).alias("start"), "n_words", F.col("doc_id").alias("match_doc_id"), F.lit(0).alias("match_start"))
        return out.unionByName(whole)

    def without(self, spans: DataFrame, width: int, digest: bool = False) -> DataFrame:
        """(doc, n_words, n_removed, out) of each row: out is the text without the words of ``spans``
        (doc_id, start, n_words), or with ``digest`` the SHA-256 of the kept words, joined by one space.

        Texts without a span stay as they are, byte for byte. Of the others all words go, if they are
        ``width`` or more, as every window of them stands earlier.
        """
        by_doc = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "n_words")).alias("_spans"))
        return self._with_others(self._cut(by_doc, digest), width, digest)

    def without_verified(self, spans: DataFrame, width: int, digest: bool = False) -> DataFrame:
        """``without`` those spans (doc_id, start, n_words, src_doc, src_start) whose words are the ones at
        their source coordinates.

        The pass that cuts the texts also takes 96-bit digests of the words of every block of a span,
        here and in its source; only the digests are compared. A span with a block that differs is
        left in: then, which is next to never, the texts are cut once more without it.
        """
        got = staged(self._cut(_requests(spans), digest), "cut")
        proofs = got.select("doc_id", F.inline("_proof"))
        block = ["doc", "at", "n", "digest"]
        wrong = proofs.groupBy(*block).agg(F.bool_or(~F.col("own")).alias("_there")).filter(~F.col("_there")).select(*block)
        if not wrong.isEmpty():
            bad = proofs.filter("own").join(wrong, block, "left_semi").select("doc_id", "start", F.col("doc").alias("src_doc")).distinct()
            return self.without(spans.join(bad, ["doc_id", "start", "src_doc"], "left_anti"), width, digest)
        return self._with_others(got, width, digest)

    def _cut(self, by_doc: DataFrame, digest: bool) -> DataFrame:
        # the spans are hashed, a row a document, so that the texts need not be sorted
        j = self.rows.join(by_doc.hint("shuffle_hash"), self.rows["doc_id"] == by_doc["_id"], "left").drop("_id")
        more = f", _proof {_PROOF}" if "_wanted" in by_doc.columns else ""
        out = T.StructType([*self.rows.select("doc_id", "doc").schema.fields, *T.StructType.fromDDL("n_words long, n_removed long, out string" + more).fields])
        return j.mapInArrow(_cutter(digest), out)

    def _with_others(self, cut: DataFrame, width: int, digest: bool) -> DataFrame:
        cut = cut.select("doc", "n_words", "n_removed", "out")
        if self.others is None:
            return cut
        w = words(F.col("text"))
        o = self.others.select("doc", F.size(w).cast("long").alias("n_words"), (F.array_join(w, " ") if digest else F.col("text")).alias("_left"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))))
        goes = F.col("n_words") >= width
        left = F.when(goes, F.lit("")).otherwise(F.col("_left"))
        return cut.unionByName(o.select("doc", "n_words", F.when(goes, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), (F.sha2(F.encode(left, "UTF-8"), 256) if digest else left).alias("out")))


def compact(runs: DataFrame) -> DataFrame:
    """Glue runs that go on from one another, in the document and in the source, to longest ones.

    Runs of one diagonal (document, source, shift) come from several partitions; sorted by start, a
    run that begins where the last ended continues it.
    """
    by = Window.partitionBy("doc_id", "src_doc", "_shift").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumn("_shift", F.col("start") - F.col("src_start"))
    r = r.withColumn("_new", (F.coalesce(F.max(F.col("start") + F.col("n")).over(by), F.lit(-1)) < F.col("start")).cast("int"))
    r = r.withColumn("_path", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = r.groupBy("doc_id", "src_doc", "_shift", "_path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("_end"))
    return out.select("doc_id", "start", (F.col("_end") - F.col("start")).alias("n"), "src_doc", (F.col("start") - F.col("_shift")).alias("src_start"))


def _covered(n: int, spans) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for x in spans:
        a, b = min(n, x["start"]), min(n, x["start"] + x["n_words"])
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


_PROOFS = pa.list_(pa.struct([("own", pa.bool_()), ("start", pa.int32()), ("doc", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))


def _proofs(doc_id: int, ws: list[bytes], spans, wanted) -> list[dict]:
    """Digests of the blocks of a document's own spans, by their place in the source, and of those
    that others want of it."""
    of = lambda a, n: hashlib.blake2b(b" ".join(ws[a : a + n]), digest_size=12).digest()
    out = [{"own": False, "start": None, "doc": doc_id, "at": w[0], "n": w[1] + 1, "digest": of(w[0], w[1] + 1)} for w in (divmod(w, BLOCK) for w in wanted)]
    for x in spans:
        here, at, end = x["start"], x["src_start"], x["src_start"] + x["n_words"]
        while at < end:
            n = min(end - at, BLOCK - at % BLOCK)
            out.append({"own": True, "start": x["start"], "doc": x["src_doc"], "at": at, "n": n, "digest": of(here, n)})
            here, at = here + n, at + n
    return out


def _cutter(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                s, e, d = cut_words(data, off)
                begin = np.searchsorted(d, np.arange(len(off)), "left")
                raw, spans = data.tobytes(), part.column("_spans").to_pylist()
                texts = part.column("text")
                wanted = part.column("_wanted").to_pylist() if "_wanted" in part.schema.names else None
                ids, proofs = part.column("doc_id").to_pylist(), []
                n_words, removed, out = [], [], []
                for i in range(len(part)):
                    a, b = int(begin[i]), int(begin[i + 1])
                    gone = _covered(b - a, spans[i] or ())
                    n_words.append(b - a)
                    removed.append(int(gone.sum()))
                    ws = raw[off[i] : off[i + 1]].split() if digest or spans[i] or wanted and wanted[i] else []
                    if wanted is not None:
                        proofs.append(_proofs(ids[i], ws, spans[i] or (), wanted[i] or ()))
                    if digest:
                        kept = ws if not removed[-1] else [w for w, g in zip(ws, gone, strict=True) if not g]
                        out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    elif not removed[-1]:
                        out.append(texts[i].as_py())
                    else:
                        # whole stretches go, with the white space before each of their words
                        keep = np.ones(int(off[i + 1] - off[i]), bool)
                        last = int(off[i])
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                        for x, y in zip(edges[::2], edges[1::2], strict=True):
                            lo = int(e[a + x - 1]) if x else int(off[i])
                            keep[lo - last : int(e[a + y - 1]) - last] = False
                        mine = data[off[i] : off[i + 1]]
                        out.append(mine[keep].tobytes().decode("utf-8", "replace").lstrip(" \t\n\x0b\x0c\r"))
                names = ["doc_id", "doc"]
                cols = [*map(part.column, names), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
                names += ["n_words", "n_removed", "out"]
                if wanted is not None:
                    cols, names = [*cols, pa.array(proofs, _PROOFS)], [*names, "_proof"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _requests(spans: DataFrame) -> DataFrame:
    """(_id, its own spans, the blocks that spans of others and its own take from it: at * BLOCK + n - 1)."""
    begin, end = F.col("src_start"), F.col("src_start") + F.col("n_words")

    def block(b):
        lo, hi = F.greatest(begin, (b * BLOCK).cast("int")), F.least(end, ((b + 1) * BLOCK).cast("int"))
        return F.struct(F.col("src_doc").alias("_id"), F.lit(None).alias("own"), (lo.cast("long") * BLOCK + (hi - lo) - 1).alias("part"))

    of = F.struct(F.col("doc_id").alias("_id"), F.struct("start", "n_words", "src_doc", "src_start").alias("own"), F.lit(None).alias("part"))
    blocks = F.transform(F.sequence(F.floor(begin / BLOCK), F.floor((end - 1) / BLOCK)), block)
    rows = spans.select(F.inline(F.concat(F.array(of), blocks)))
    return rows.groupBy("_id").agg(F.collect_list("own").alias("_spans"), F.collect_set("part").alias("_wanted"))
