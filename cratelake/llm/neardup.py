"""Near copies at a similarity: wide SimHash fingerprints, a grid join over the bit counts of their segments,
and the shingles of the two texts decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratelake.llm.common import staged
from cratelake.llm.documents import text_key
from cratelake.llm.graph import components
from cratelake.llm.simhash import counts, majority, unary
from cratelake.llm.wordspans import cut_words, grams, mix, slices, word_hashes

#: 64-bit SimHashes of a text, with independent hashes.
PRINTS = 8
#: Rounds in which a member is compared with one leader only, before all that are still apart are.
STARS = 2
#: Members up to which the pairs of a grid cell are compared one by one; more are a crowd.
CELL = 32
#: Members, and bytes of their texts, that make a block of a crowd: two blocks are in a task at a time.
BLOCK, BLOCK_BYTES = 512, 4_000_000
#: Rows up to which a table of (hash, id, key) is broadcast: 32 MB at most.
BROADCAST = 1_000_000
#: At Jaccard similarity 0.8 the cosine of two shingle sets is 0.889 at least, and a bit differs with a
#: chance of 0.1515: of 512 bits 78 differ (deviation 8.1), so that these bits are 3.9 deviations off. Unrelated
#: texts differ in 256 (11.3).
MOST_BITS = 110
#: Of one SimHash 9.7 bits differ at 0.8 (deviation 2.9), so that these are 4.3 deviations off; of unrelated texts 32
#: (4.0). The Manhattan distance of the bit counts is never more.
FIRST_BITS = 22
#: Two-bit segments whose bit counts make a cell, and cells that a text is in. The counts of a segment agree with a chance
#: of 0.731 at similarity 0.80 and of 0.375 in unrelated texts: two independent texts at 0.80 share a cell with a
#: chance of 0.93, at 0.82 of 0.96, at 0.85 of 0.99. The same for every size of table.
SEGMENTS, CELLS = 12, 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sets(data: np.ndarray, off: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The hashes of each text's word shingles, as sorted sets; a text of fewer words is one shingle."""
    s, e, d = cut_words(data, off)
    h = word_hashes(data, s, e)
    begin = np.searchsorted(d, np.arange(len(off)), "left")
    g, sets = grams(h, shingle), []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        sets.append(np.unique(g[a : b - shingle + 1] if b - a >= shingle else grams(h[a:b], b - a)) if b > a else h[:0])
    return sets


def _sketch(shingle: int):
    rng = np.random.default_rng(11)
    odd, flip = (rng.integers(0, 1 << 63, PRINTS, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                sets = _sets(_LOWER[data], off, shingle)
                n = np.array([len(x) for x in sets])
                full = np.flatnonzero(n)
                sig, prints = np.zeros(len(sets), np.uint64), np.zeros((len(sets), PRINTS), np.uint64)
                if len(full):
                    all_of, at, doc = np.concatenate(sets), (np.cumsum(n) - n)[full], np.repeat(np.arange(len(n)), n)
                    sig[full] = mix(np.add.reduceat(mix(all_of + np.uint64(0x632BE59BD9B4E019)), at) + n[full].astype(np.uint64))
                    for i in range(PRINTS):
                        prints[:, i] = majority(mix(all_of * odd[i] ^ flip[i]), doc, n)
                fps = pa.FixedSizeListArray.from_arrays(pa.array(prints.reshape(-1).view(np.int64)), PRINTS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(sig.view(np.int64)), fps, pa.array(n > 0)], ["doc_id", "key", "sig", "fps", "full"])

    return run


def _grid(segments: int, cells: int):
    """The cells (cell, sig, fp) of each text, fp its first SimHash: a cell is a choice of segments and their bit counts."""
    rng = np.random.default_rng(12)
    chosen = np.stack([rng.choice(32 * PRINTS, segments, replace=False) for _ in range(cells)])
    if cells * 3**segments >= 1 << 63:
        raise ValueError("a cell has no number of 64 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                part = whole.slice(i, 1024)
                sig = part.column("sig").to_numpy()
                prints = part.column("fps").flatten().to_numpy().view(np.uint64).reshape(len(sig), PRINTS)
                many = counts(prints)
                cell = np.tile(np.arange(cells), (len(sig), 1))
                for j in range(segments):
                    cell = cell * 3 + many[:, chosen[:, j]]
                first = np.repeat(prints[:, 0].view(np.int64), cells)
                yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1)), pa.array(np.repeat(sig, cells)), pa.array(first)], ["cell", "sig", "fp"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, sig, fp) come by cell; those go on that have another one in their cell at a distance of ``FIRST_BITS``: the
    Manhattan distance of the bit counts discards, the bits decide. A cell of over ``BLOCK`` members goes on whole."""
    held: list[pa.RecordBatch] = []

    def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sig, fp = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("cell", "sig", "fp"))
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(new, len(cell)))
        size, left = np.repeat(size, size), np.repeat(new + size, size) - np.arange(len(cell))
        fp, keep = fp.view(np.uint64), size > BLOCK
        flat = unary(fp)
        rest = np.flatnonzero((size > 1) & ~keep)
        for lag in range(1, BLOCK):
            rest = rest[left[rest] > lag]
            if not len(rest):
                break
            a = rest[np.bitwise_count(flat[rest] ^ flat[rest + lag]) <= FIRST_BITS]
            a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= FIRST_BITS]
            keep[a] = keep[a + lag] = True
        yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(sig[keep])], ["cell", "sig"])

    for b in batches:
        at = b.column("cell").to_numpy()
        if not len(at):
            continue
        cut = int(np.searchsorted(at, at[-1]))  # the last cell may go on in the next batch
        if cut or held and held[-1].column("cell")[-1] != b.column("cell")[0]:
            yield from out([*held, b.slice(0, cut)] if cut else held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield from out(held)


def _verify(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(text: str) -> np.ndarray:
            data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
            return _sets(data, np.array([0, len(data)]), shingle)[0]

        for batch in batches:
            ok, last, p = [], None, None
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a != last:
                    last, p = a, of(x.as_py())
                q = of(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near(a: Column, b: Column) -> Column:
    """Whether all the SimHashes of two texts together are near."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) <= MOST_BITS


def _dealt(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """The members of each key in so many blocks by a hash of sig, and a row for each pair of blocks that a member is in:
    any two members of a key are together in one group (key, lo, hi) at least."""
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumn("lo", F.least("mine", "_other")).withColumn("hi", F.greatest("mine", "_other")).drop("_blocks", "_other")


def _forest(crowd: pa.Table, label: np.ndarray, confirmed: Callable[[int, np.ndarray], np.ndarray]) -> pa.Table:
    """Links (a, b), no more than members, that join whatever members of two blocks are near by their SimHashes, have different
    roots and are confirmed; members of one label need no link."""
    sig, root, mine = (crowd.column(c).to_numpy() for c in ("sig", "root", "mine"))
    prints = crowd.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(sig), PRINTS)
    hi, links = int(crowd.column("hi")[0].as_py()), []
    for i in np.flatnonzero(mine == crowd.column("lo")[0].as_py()).tolist():
        others = np.flatnonzero((mine == hi) & (label != label[i]) & (root != root[i]))
        others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(1) <= MOST_BITS]
        others = confirmed(i, others) if len(others) else others
        met, first = np.unique(label[others], return_index=True)
        links += [(int(sig[i]), int(sig[j])) for j in others[first].tolist()]
        label[np.isin(label, met)] = label[i]
    return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _alike(crowd: pa.Table) -> pa.Table:
    """Links of two blocks of a cell by the SimHashes alone: of each member to the least that it is joined with."""
    label, sig = np.arange(len(crowd)), crowd.column("sig").to_numpy()
    _forest(crowd, label, lambda i, others: others)
    least = np.full(len(sig), np.iinfo(np.int64).max)
    np.minimum.at(least, label, sig)
    rest = least[label] != sig
    return pa.table([pa.array(least[label][rest], pa.int64()), pa.array(sig[rest], pa.int64())], ["a", "b"])


def _few_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_alike``, of cells that come with all of their members: what is joined by pairs that are near and have different
    roots is linked to its least, a link a member at most, not one a pair."""
    for whole in batches:
        for at in range(0, len(whole), 1024):
            cells = whole.column("all").slice(at, 1024)
            size = np.diff(cells.offsets.to_numpy())
            sig, fps, root = cells.flatten().flatten()
            sig, root, cell = sig.to_numpy(), root.to_numpy(), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((sig, cell))  # a cell stays where it is
            sig, root, prints = sig[order], root[order], fps.flatten().to_numpy().view(np.uint64).reshape(len(sig), PRINTS)[order]
            left, rest, pairs = np.repeat(np.cumsum(size), size) - np.arange(len(sig)), np.arange(len(sig)), []
            for lag in range(1, int(size.max(initial=0))):
                rest = rest[left[rest] > lag]
                a = rest[root[rest] != root[rest + lag]]
                a = a[np.bitwise_count(prints[a] ^ prints[a + lag]).sum(1) <= MOST_BITS]
                pairs.append((a, a + lag))
            x, y = (np.concatenate([p[k] for p in pairs]) if pairs else rest[:0] for k in (0, 1))
            label, last = np.arange(len(sig)), None
            while last is None or (label != last).any():
                last, label = label, label.copy()
                low = np.minimum(last[x], last[y])
                np.minimum.at(label, x, low)
                np.minimum.at(label, y, low)
                label = label[label]
            rest = np.flatnonzero(label != np.arange(len(sig)))
            yield pa.RecordBatch.from_arrays([pa.array(sig[label[rest]]), pa.array(sig[rest])], ["a", "b"])


def _borne_out(shingle: int, least: float):
    """Links of two blocks of a crowd that the shingles of the texts bear out."""

    def run(crowd: pa.Table) -> pa.Table:
        sets = [_sets(_LOWER[np.frombuffer(t.as_py().encode(), np.uint8)], np.array([0, len(t.as_py().encode())]), shingle)[0] for t in crowd.column("text")]
        n = np.array([len(x) for x in sets])
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        end, marked = np.cumsum(n), np.zeros(len(known), bool)

        def confirmed(i: int, others: np.ndarray) -> np.ndarray:
            marked[own := codes[end[i] - n[i] : end[i]]] = True
            both = np.array([np.count_nonzero(marked[codes[end[j] - n[j] : end[j]]]) for j in others.tolist()])
            marked[own] = False
            return others[both >= least * (n[i] + n[others] - both)]

        return _forest(crowd, np.unique(crowd.column("root").to_numpy(), return_inverse=True)[1], confirmed)

    return run


class _Texts:
    """The distinct texts of a table, by sig, and the check of pairs of them."""

    def __init__(self, rows: DataFrame, unique: DataFrame, shingle: int, least: float):
        self.rows, self.unique, self.shingle, self.least = rows, unique, shingle, least

    def of(self, sigs: DataFrame) -> DataFrame:
        """(sig, text) of distinct sigs."""
        reps = staged(self.unique.join(sigs, "sig").select("sig", F.col("of.doc_id").alias("_id"), F.col("of.key").alias("_key")), "reps")
        few = reps.count() <= BROADCAST
        found = self.rows.join(F.broadcast(reps) if few else reps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
        return staged(found.select("sig", "text").dropDuplicates(["sig"]), "texts")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of sigs that the texts bear out."""
        pairs = staged(pairs, "pairs")
        texts = self.of(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
        named = lambda c, t: texts.select(F.col("sig").alias(c), F.col("text").alias(t))
        both = pairs.join(named("b", "y"), "b").join(named("a", "x"), "a")
        return staged(both.select("a", "b", "x", "y").mapInArrow(_verify(self.shingle, self.least), "a long, b long"), "near")

    def crowds(self, met: DataFrame, few: DataFrame, crowded: DataFrame) -> DataFrame:
        """Links (a, b) between members of cells (sig, fps, root), as if all the pairs that the SimHashes give were
        compared: those that the links ``few`` stand for, and all of each crowded cell (cell, n, sig, fps, root).

        Members that the SimHashes join, in one cell or from one to the next, are a crowd; its members are compared by their
        texts in blocks, once, however many cells they share.
        """
        crowded = _dealt(crowded, "cell", F.ceil(F.col("n") / BLOCK)).drop("n")
        alike = few.unionByName(crowded.groupBy("cell", "lo", "hi").applyInArrow(_alike, "a long, b long"))
        crowd = components(staged(_hung(_hung(alike)), "alike")).select(F.col("node").alias("sig"), F.col("root").alias("crowd"))
        crowd = staged(met.select("sig", "fps", "root").join(crowd, "sig").dropDuplicates(["sig"]), "crowds")
        texts = crowd.join(self.of(crowd.select("sig")), "sig")
        blocks = texts.groupBy("crowd").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("blocks"))
        dealt = _dealt(texts.join(blocks, "crowd"), "crowd", F.greatest("blocks", F.lit(1))).drop("blocks")
        return staged(dealt.groupBy("crowd", "lo", "hi").applyInArrow(_borne_out(self.shingle, self.least), "a long, b long"), "near")


def _hung(links: DataFrame) -> DataFrame:
    """Links that join what the links (a, b), a < b, join, fewer where the cells of a member name many least ones: these hang
    on the least of them. A member has no more of them than it has cells and blocks."""
    near = links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("_all"))
    return near.select(F.col("_all")[0].alias("a"), F.explode(F.concat(F.array("b"), F.slice("_all", F.lit(2), F.size("_all")))).alias("b")).distinct()


def _stars(met: DataFrame) -> DataFrame:
    """One pair (a, b) for each member: with the member of another root, near by the fingerprints, that leads one of
    its cells. A cell's leader is its member of the greatest degree, a second one that of another root."""
    w = Window.partitionBy("cell")
    me = F.struct("degree", "sig", "fps", "root")
    met = met.withColumn("_one", F.max(me).over(w))
    met = met.withColumn("_two", F.max(F.when(F.col("root") != F.col("_one.root"), me)).over(w))
    lead = F.when(F.col("root") != F.col("_one.root"), F.col("_one")).otherwise(F.when(F.col("sig") == F.col("_one.sig"), None).otherwise(F.col("_two")))
    near = met.withColumn("_lead", lead).filter(_near(F.col("_lead.fps"), F.col("fps")))
    return near.groupBy(F.col("sig").alias("b")).agg(F.max(F.struct("_lead.degree", "_lead.sig")).alias("_a")).select(F.col("_a.sig").alias("a"), "b")


def _links(met: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join what pairs of different roots, near by the fingerprints, join in cells with up to
    ``cell`` members; and the rows of larger cells."""
    w = Window.partitionBy("cell")
    met = met.withColumn("n", F.count("*").over(w)).withColumn("_lo", F.min(F.struct("root", "sig")).over(w)).withColumn("_hi", F.max(F.struct("root", "sig")).over(w))
    met = met.filter(F.col("_lo.root") != F.col("_hi.root")).drop("degree")
    few = met.filter(F.col("n") <= cell).groupBy("cell").agg(F.collect_list(F.struct("sig", "fps", "root")).alias("all"))
    return few.select("all").mapInArrow(_few_alike, "a long, b long"), met.filter(F.col("n") > cell)


def _linked(rows: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    return rows.drop("root").join(roots, F.col("sig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sig")).drop("node")


def groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, cell: int = CELL, segments: int = SEGMENTS, cells: int = CELLS) -> DataFrame:
    """(doc_id, key, root) of each row: rows with one root are linked by steps of at least ``least``
    Jaccard similarity of their sets of ``shingle``-word shingles, A-Z as a-z; key is ``text_key``.

    Equal sets are one member (64 bits of their hash). Others have ``PRINTS`` SimHashes, whose two-bit segments are embedded
    as their bit counts, as in operator 7. Grid range join: a cell is a choice of ``segments`` coordinates of
    the embedding; those that share one of ``cells`` cells meet, the Manhattan distance of the counts discards and the
    bits decide. First every member is compared with one leader of its cells; then, in cells that still hold
    different groups, all pairs of these. Of each pair all SimHashes, and at last the texts must be near. In cells of over
    ``cell`` members the pairs are compared inside of tasks, in blocks, which give links enough to join what is near, not
    all pairs.

    Nothing depends on the number of rows. Unrelated texts meet by chance in a cell with 0.375**``segments``: for tables of far
    over 50,000,000 texts more ``segments``, with more ``cells`` for the same recall (14, 210), save comparisons.

    Texts without a word, and nulls, are one group; short texts are one shingle; very long texts are read whole; repeated rows
    have one root; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))
    prints = staged(rows.mapInArrow(_sketch(shingle), "doc_id long, key long, sig long, fps array<long>, full boolean"), "prints")
    unique = prints.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("of"), F.first("fps").alias("fps"), F.first("full").alias("full"))
    unique = staged(unique, "unique")
    texts = _Texts(rows, unique, shingle, least)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = unique.filter("full").select("sig", "fps").repartition(parts, "sig").mapInArrow(_grid(segments, cells), "cell long, sig long, fp long")
    near = every.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_ranges, "cell long, sig long")
    met = staged(near.withColumn("n", F.count("*").over(Window.partitionBy("cell"))), "cells")
    # the text that the others are copies of meets most of them, while they, each with edits of its own, meet less often
    degree = staged(met.groupBy("sig").agg(F.sum("n").alias("degree")), "degrees")
    met = staged(met.drop("n").join(degree, "sig").join(unique.select("sig", "fps"), "sig").withColumn("root", F.col("sig")), "cells")
    links = None
    for _ in range(STARS):
        near = texts.near(_stars(met))
        links = near if links is None else links.unionByName(near)
        met = staged(_linked(met, links), "cells")
    few, crowded = _links(met, cell)
    links = links.unionByName(texts.crowds(met, few, crowded.select("cell", "n", "sig", "fps", "root")))
    named = _linked(unique.select("sig"), links)
    return prints.select("doc_id", "key", "sig").join(named, "sig").select("doc_id", "key", "root")
