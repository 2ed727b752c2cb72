"""The pipeline operators against brute force on small tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cratelake.llm import debruijn, fixity, language, mixing, packing, quality_model, quality_rules, sampling, simhash, suffixes
from cratelake.llm.documents import Documents, compact, text_key, unpacked
from cratelake.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed, n):
    return " ".join(hashlib.md5(f"{seed}.{i}".encode()).hexdigest()[: 3 + i % 5] for i in range(n))


TEXTS = [
    None, "", "  \t\n ", "one", "the the the the the the the the the the the the the the the the the the the the the the the the the",
    passage(1, 80), passage(1, 80), passage(2, 30) + " " + passage(1, 80), passage(3, 60) + "\n" + passage(2, 30), passage(4, 4000), passage(3, 60) + " tail",
    "café <|endoftext|> 'LL  " + passage(5, 70), passage(1, 79) + " other",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, passage(1, 80), "en", "a", 1)], SCHEMA).cache()


def repeats(width):
    seen, out = set(), {}
    for i, t in enumerate(TEXTS):
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for p in range(len(ws) - width + 1):
            w = tuple(ws[p : p + width])
            if w in seen:
                gone[p : p + width] = [True] * width
            seen.add(w)
        out[i] = ws, gone
    return out


def runs_of(docs, width, **options):
    texts = Documents(docs.select("doc_id", "text")).texts
    if width == 50:
        return compact(suffixes.repeated_windows(texts, 50, 16, **options)).withColumnRenamed("n", "n_words").withColumn("n_words", F.col("n_words") + 49)
    return debruijn.debruijn_repeats(texts, width)


@pytest.mark.parametrize("width, options", [(50, {}), (50, {"hot": 1}), (20, {})])
def test_repeated_passages(docs, width, options):
    want = repeats(width)
    got = {i: [False] * len(ws) for i, (ws, _) in want.items()}
    for r in runs_of(docs.filter("doc_id IS NOT NULL"), width, **options).collect():
        here, there = want[r["doc_id"]][0], want[r["src_doc"]][0]
        assert here[r["start"] : r["start"] + r["n_words"]] == there[r["src_start"] : r["src_start"] + r["n_words"]]
        assert (r["src_doc"], r["src_start"]) < (r["doc_id"], r["start"])
        got[r["doc_id"]][r["start"] : r["start"] + r["n_words"]] = [True] * r["n_words"]
    assert got == {i: g for i, (_, g) in want.items()}


def test_hot_minimisers_lose_no_edge(monkeypatch, docs):
    monkeypatch.setattr(debruijn, "HOT_RUNS", 1)
    monkeypatch.setattr(debruijn, "HOT_SHARE", 0)
    assert len(debruijn.hot_minimisers(Documents(docs.filter("doc_id IS NOT NULL")).texts, 20, 10))
    test_repeated_passages(docs, 20, {})


def test_large_buckets_are_compared_in_parts(monkeypatch, docs):
    monkeypatch.setattr(debruijn, "TOGETHER", 7)
    test_repeated_passages(docs, 20, {})


def test_suffixes_of_one_key_over_many_batches(spark):
    base, rows = passage(31, 16), []
    for i in range(300):  # one gram of 16 words with 300 surroundings, of which each comes twice
        j = i // 2
        rows.append((i, f"{passage(1000 + j, 40)} {base} {passage(2000 + j, 40)}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = suffixes.sparse_suffix_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["doc_id"], r["start"], r["n_words"], r["match_doc_id"], r["match_start"]) for r in got) == [(2 * j + 1, 0, 96, 2 * j, 0) for j in range(150)]


def test_matches_reach_as_far_as_the_words_agree(spark):
    shared = passage(41, 120).split()
    rows = [(1, " ".join(["a", *shared[:70], "b"])), (2, " ".join(["c", "d", *shared, "e"])), (3, " ".join([*shared, "f"]))]
    got = suffixes.sparse_suffix_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(2, 2, 70, 1, 1), (3, 0, 120, 2, 2)]


def test_no_match_could_be_longer(spark, docs, monkeypatch):
    """Where the nearest earlier place changes inside a passage, each place's match still reaches its own ends."""
    p, far = passage(42, 120).split(), passage(43, 5000).split()
    rows = [(1, " ".join(p)), (2, " ".join(["x", *p[30:90], "y"])), (3, " ".join(p)), (4, " ".join(far)), (5, " ".join(["u", *far[2000:2060], "v"])), (6, " ".join(far))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(2, 1, 60, 1, 30), (3, 0, 120, 1, 0), (3, 30, 60, 2, 1), (5, 1, 60, 4, 2000), (6, 0, 5000, 4, 0), (6, 2000, 60, 5, 1)]
    assert sorted(tuple(r) for r in suffixes.sparse_suffix_repeats(df).collect()) == want
    monkeypatch.setattr(suffixes, "ASKED", 7)
    assert sorted(tuple(r) for r in suffixes.sparse_suffix_repeats(df).collect()) == want
    words_of = {i: (t or "").split() for i, t in enumerate(TEXTS)}
    at = lambda i, j: words_of[i][j] if 0 <= j < len(words_of[i]) else (i, j)  # noqa: E731  (beyond a text nothing is alike)
    for r in suffixes.sparse_suffix_repeats(docs.filter("doc_id IS NOT NULL")).collect():
        a, x, n, b, y = r
        assert all(at(a, x + j) == at(b, y + j) for j in range(n))
        assert at(a, x - 1) != at(b, y - 1) and at(a, x + n) != at(b, y + n)


def test_paths_end_where_the_graph_branches(spark):
    p, q, r = (passage(s, 40) for s in (51, 52, 53))
    rows = [(1, f"{p} {q}"), (2, f"x {p} {q} y"), (3, f"{p} {r}"), (4, f"z {p} {r}")]
    got = debruijn.debruijn_repeats(Documents(spark.createDataFrame(rows, "doc_id long, text string")).texts, 20).collect()
    paths = {}
    for x in got:
        paths.setdefault(x["doc_id"], []).append((x["start"], x["n_words"], x["path"]))
    two, three, four = (sorted(paths[i]) for i in (2, 3, 4))
    # after the last edge inside p the graph branches to q and to r
    assert [x[:2] for x in two] == [(1, 40), (22, 59)] and [x[:2] for x in three] == [(0, 40)]
    assert [x[:2] for x in four] == [(1, 40), (22, 59)]
    assert two[0][2] == three[0][2] == four[0][2] and len({two[1][2], four[1][2], two[0][2]}) == 3


def cut_of(docs, spans, verified=False, digest=True):
    d = Documents(docs)
    return (d.without_verified if verified else d.without)(spans, 20, digest)


def test_cut_keeps_clean_texts(docs):
    want = repeats(20)
    some = docs.filter("doc_id IS NOT NULL")
    spans = runs_of(some, 20)
    for r in unpacked(cut_of(some, spans, digest=False), ["doc_id", "text"], text="out").collect():
        ws, gone = want[r["doc_id"]]
        assert (r["text"] or "").encode().split() == [w for w, g in zip(ws, gone, strict=True) if not g]
        if not any(gone):
            assert r["text"] == TEXTS[r["doc_id"]]
    digests = {r["doc_id"]: r["out"] for r in cut_of(some, spans).select("doc.doc_id", "out").collect()}
    assert all(digests[i] == hashlib.sha256(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)).hexdigest() for i, (ws, gone) in want.items())


def test_cut_leaves_spans_that_differ_from_their_source(spark, docs):
    want = repeats(20)
    some = docs.filter("doc_id IS NOT NULL")
    true = runs_of(some, 20).drop("path")
    false = spark.createDataFrame([(9, 100, 200, 4, 0), (9, 1000, 130, 5, 10)], "doc_id long, start int, n_words int, src_doc long, src_start int")
    for spans in (true, true.unionByName(false.select(*[F.col(c).cast(t) for c, t in true.dtypes]))):
        got = {r["doc_id"]: r for r in cut_of(some, spans, verified=True).select("doc.doc_id", "n_words", "n_removed", "out").collect()}
        assert sorted(got) == sorted(want)
        for i, (ws, gone) in want.items():
            kept = [w for w, g in zip(ws, gone, strict=True) if not g]
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["out"]) == (len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_rows_of_one_id_and_without_one_are_documents_in_turn(spark):
    rows = [(1, passage(1, 60)), (1, passage(1, 60)), (1, passage(1, 60)), (2, "x " + passage(1, 55)), (2, passage(2, 70)), (None, passage(2, 70)), (None, passage(3, 30)), (None, passage(3, 30)), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r["text"]: r["k"] for r in df.select("text", text_key(F.col("text")).alias("k")).collect()}
    line = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, key[r[1]]))
    seen, want = set(), []
    for i, t in line:
        ws = (t or "").split()
        gone = [False] * len(ws)
        for p in range(len(ws) - 19):
            w = tuple(ws[p : p + 20])
            if w in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(w)
        want.append((i is None, i or 0, len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode()).hexdigest()))
    d = Documents(df)
    got = d.without_verified(debruijn.debruijn_repeats(d.texts), 20, digest=True).select("doc.doc_id", "n_words", "n_removed", "out").collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == sorted(want)
    found = collections.Counter((r["doc_id"], r["n_words"]) for r in suffixes.sparse_suffix_repeats(df).collect())
    assert found == {(1, 60): 2, (2, 55): 1, (None, 70): 1}


def test_simhash(docs):
    def fp(t):
        ws = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))] if ws else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = {r["doc_id"]: r for r in simhash.simhash_components(docs, 4, 4).filter("doc_id IS NOT NULL").collect()}
    prints = [fp(t) for t in TEXTS]
    label = list(range(len(prints)))
    for _ in prints:
        label = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(prints))]
    assert [got[i]["component_id"] for i in range(len(prints))] == label
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(prints))] == prints


def test_crowded_cells_lose_no_link(spark):
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(0, 2**63, 2, dtype=np.uint64):
        for _ in range(60):
            v = base
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                v ^= np.uint64(1) << np.uint64(b)
            values.add(int(v.view(np.int64)))
    values = sorted(values)
    u = np.array(values).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    label = np.arange(len(values))
    for _ in values:
        label = np.array([label[row].min() for row in near])
    roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, cell=6)).collect()}
    assert [roots.get(v, v) for v in values] == [values[i] for i in label]


def test_packing_is_gapless_and_exact(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(packing.token_pieces(docs.filter("doc_id IS NOT NULL"), capacity=128), capacity=128, groups=4, small=16).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for p, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (p, at) and (p == 0 or r["length"] == 128)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128


def test_fingerprints_estimate_generalised_jaccard(docs):
    both = docs.filter("doc_id IS NOT NULL").selectExpr("doc_id", "text AS a", "concat(coalesce(text, ''), ' one two three') AS b")
    rows = sampling.signatures(both, "doc_id", ["a", "b"], samples=256).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["a"] == by[6]["a"] and len(by) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        a, b = collections.Counter((t or "").split(" ")), collections.Counter(((t or "") + " one two three").split())
        a = collections.Counter((t or "").split())
        j = sum((a & b).values()) / sum((a | b).values())
        assert abs(np.mean(np.array(by[i]["a"]) == np.array(by[i]["b"])) - j) < 0.17
    nxt = {r["doc_id"]: r["next_id"] for r in sampling.ring(both.select("doc_id")).collect()}
    assert nxt == {i: (i + 1) % len(TEXTS) for i in range(len(TEXTS))}


@pytest.mark.parametrize("n", [1_000, 50_000, 1_000_000])
def test_fingerprints_of_long_texts(spark, n):
    """Within 3 standard errors of the truth, 1/2, whatever the number of words."""
    text = lambda first: " ".join(f"w{i}" for i in range(first, first + n))
    r = sampling.signatures(spark.createDataFrame([(1, text(0), text(n // 3))], "doc_id long, a string, b string"), "doc_id", ["a", "b"]).first()
    assert abs(np.mean(np.array(r["a"]) == np.array(r["b"])) - 0.5) < 3 * (0.25 / 64) ** 0.5


def test_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the quick brown fox and the dog", "en"), ("le renard brun et les chiens", "fr")] * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the fox and the dog"), (2, "les chiens et le renard"), (3, None), (4, "12 ... !"), (5, "")], "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r for r in language.detect(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "fr", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_rules_count_as_brute_force(docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        ws = (t or "").split()
        tri = [tuple(ws[j : j + 3]) for j in range(len(ws) - 2)]
        n = collections.Counter(tri)
        inside = {k for j, w in enumerate(tri) if n[w] > 1 for k in (j, j + 1, j + 2)}
        lines = [x.strip() for x in (t or "").split("\n")]
        dup = sum(x != "" and (t or "").split("\n").index(y) < j for j, (x, y) in enumerate(zip(lines, (t or "").split("\n"), strict=True)))
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(ws), len(inside), sum(map(len, ws)))
        assert (got[i]["n_symbols"], got[i]["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t or ""), dup)
        assert got[i]["base_failed"] == (len(ws) < 50 or 100 * len(inside) > 50 * len(ws))
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_configurations_near_the_fewest_bins():
    rng = np.random.default_rng(7)
    lengths = np.sort(np.clip(rng.lognormal(5.9, 0.5, 3000).astype(int), 97, 1023))[::-1].tolist()
    sizes, counts = lengths[::16], [len(lengths[g : g + 16]) for g in range(0, len(lengths), 16)]
    plan, held = packing.configurations(sizes, counts, 1024), [0] * len(sizes)
    for times, fill in plan:
        assert times > 0 and sum(sizes[i] * n for i, n in fill) <= 1024
        for i, n in fill:
            held[i] += times * n
    least = sum(s * n for s, n in zip(sizes, counts, strict=True)) / 1024
    assert held == counts and least <= sum(t for t, _ in plan) <= 1.02 * least
    assert sum(t for t, _ in packing.configurations([50, 30, 20], [3, 3, 3], 100)) == 3
    assert packing.configurations([1000], [5], 1024) == [(5, [(0, 1)])]


def test_common_words_as_constants_or_joined(spark, monkeypatch):
    rows = [(i, " ".join(["The", "of", "the", *passage(i, 60).split(), "of"][: 3 + i % 70]), ["en", "fr", None][i % 3], "a", 1) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    vocabulary = quality_rules.common_words(df)
    some = lambda: sorted(tuple(r) for r in quality_rules.word_shares(df, vocabulary).select("key", "word", "n_words", "share").collect())
    want = some()
    assert {w for _, w, _, _ in want} == {"", "the", "of"} | {r["word"] for r in vocabulary.collect()}
    monkeypatch.setattr(quality_rules, "FEW", 0)
    assert some() == want


def test_discriminant(spark):
    clean, junk = [passage(i, 60).capitalize() + "." for i in range(30)], [" ".join(w + "###" for w in passage(i, 60).split()) for i in range(30)]
    stats = quality_model.measured(spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string"))
    model = quality_model.fit(stats.selectExpr("x", "cast(doc_id < 30 AS int) AS quality"))
    got = {r["doc_id"]: r["score"] for r in quality_model.scored(stats, model).collect()}
    assert all((got[i] >= 0.7) == (i < 30) for i in got)
    assert quality_model.fit(stats.selectExpr("x", "1 AS quality")) is None


def test_mixing_meets_targets(spark):
    rows = [(i, ["a", "b", None][i % 7 % 3], 1 + i * 7919 % 50) for i in range(3000)]
    draws = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), block_rows=16, shard_draws=8).collect()
    taken, target = collections.Counter(), {}
    per = collections.Counter(r["doc_id"] for r in draws)
    for r in draws:
        taken[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 5 for s, t in target.items()) and max(per.values()) <= 3
    assert math.isclose(sum(target.values()), sum(s for _, _, s in rows))
    # no shard draws a document's pass that another has; shards are of like size
    assert len({(r["doc_id"], r["pass"]) for r in draws}) == len(draws)
    shards = collections.Counter(r["shard"] for r in draws)
    assert max(shards.values()) < 2 * min(shards.values()) + 50


def test_the_tree_decides_who_draws(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 9) for i in range(2000)], "doc_id long, source string, size long")
    plain = mixing.mix(rows, block_rows=16).count()
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a).filter("shard < 4"))
    assert 0 < mixing.mix(rows, block_rows=16).count() < plain / 2


def test_hypergeometric_is_a_distribution(spark):
    got = [r[0] for r in spark.range(2000).select(mixing.hypergeometric(*[mixing.F.lit(x).cast("long") for x in (30, 40, 100)], (mixing.F.col("id") + 0.5) / 2000)).collect()]
    pmf = [math.comb(40, k) * math.comb(60, 30 - k) / math.comb(100, 30) for k in range(31)]
    assert max(abs(got.count(k) / 2000 - pmf[k]) for k in range(31)) < 2e-3


def test_fixity_locates_damage(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>é" + "y" * i if i % 5 else None) for i in range(300)], "page_id long, url string, html string")
    recs = fixity.records(pages, 100)
    assert fixity.audit(recs, recs).count() == 0
    got = {r["page_id"]: r["status"] for r in fixity.audit(recs, fixity.damaged(recs)).collect()}
    assert got == {i: "missing" if i % 97 == 77 else "altered" for i in range(300) if i % 97 in (13, 41, 77)}
    back = {r["page_id"]: r["status"] for r in fixity.audit(fixity.damaged(recs), recs).collect()}
    assert {i for i, s in back.items() if s == "added"} == {i for i in range(300) if i % 97 == 77}


def test_fixity_reports_moved_records(spark):
    recs = fixity.records(spark.createDataFrame([(i, "u", f"p{i}") for i in range(100)], "page_id long, url string, html string"), 1000)
    swapped = recs.withColumn("seq", F.when(F.col("seq") == 3, 50).when(F.col("seq") == 50, 3).otherwise(F.col("seq")))
    assert sorted((r["page_id"], r["status"]) for r in fixity.audit(recs, swapped).collect()) == [(3, "moved"), (50, "moved")]


def test_fixity_counts_repeated_pages(spark):
    rows = [(i // 3 if i < 120 else i, "http://x", f"p{i // 3}" if i < 120 else f"q{i}") for i in range(200)]
    audit = lambda x, y: sorted((r["page_id"], r["status"]) for r in fixity.audit(*[fixity.records(spark.createDataFrame(t, "page_id long, url string, html string"), 1000) for t in (x, y)]).collect())
    lost = [r for i, r in enumerate(rows) if i not in (31, 64)]
    assert audit(rows, lost) == [(10, "missing"), (21, "missing")]
    assert audit(lost, rows) == [(10, "added"), (21, "added")]
    altered = [(p, u, "bad" if i in (30, 31, 32, 150) else h) for i, (p, u, h) in enumerate(rows)]
    assert audit(rows, altered) == [(10, "altered")] * 3 + [(150, "altered")]


@pytest.mark.parametrize("run", [
    lambda d: suffixes.sparse_suffix_repeats(d), lambda d: cut_of(d, runs_of(d, 20), verified=True), lambda d: simhash.simhash_components(d),
    lambda d: packing.pack(packing.token_pieces(d)), lambda d: language.detect(d, language.fit(d)), lambda d: quality_rules.judge(d), lambda d: quality_model.scored(quality_model.measured(d), None),
    lambda d: mixing.mix(d.selectExpr("doc_id", "source", "n_chars AS size")), lambda d: sampling.signatures(d, "doc_id", ["text"]),
    lambda d: fixity.audit(*[fixity.records(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html"))] * 2), lambda d: simhash.links(d.selectExpr("doc_id AS fp")),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
