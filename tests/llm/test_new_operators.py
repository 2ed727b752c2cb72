"""Collocations, whitening and url templates against brute force, and on odd rows."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cratelake.llm import collocations, urls, whitening

SF = "/root/testdata/sf0.001"

# ---- collocations


def brute_phrases(rows, least=30, share=80, most=2000):
    f, n, lower = collections.defaultdict(collections.Counter), collections.Counter(), {i: i + 32 for i in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, a in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= share * c[q[i : i + k]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


def phrases_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_op11_is_brute_force(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_phrases(rows)
    assert phrases_of(collocations.op11_collocations(spark, SF)) == want and want


def odd_texts():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        words = [rng.choice(["New", "york", "CITY", "a", "b", "é", "new"]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice([" ", "\t", "  "]).join(words) + rng.choice([".", "\r\n x", "!", ""]), rng.choice(["en", None, "und", ""])))
    rows += [("la la la la la la, la\x00b \x1c\x85 la", "fr")] * 60 + [(None, "en"), ("", None), ("  \n. ", "xx"), ("İ K\u212a " * 50, "en")]
    return rows + [("w " * 30_000 + "end of it", "long")]


@pytest.mark.parametrize("chunk", [4_000_000, 500])
def test_op11_odd_texts_in_chunks_of_any_size(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, chunk int, id string").repartition(3)
    assert phrases_of(collocations.collocations(docs, most=50)) == brute_phrases(rows, most=50)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_op11_ranks_a_row_a_key_and_keeps_no_places_of_the_longest(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 500)
    whole, keys, codes = collocations.staged, [], []

    def counted(df, name):
        out = whole(df, name)
        if name in ("often", "ranks"):
            keys.append((out.count(), out.select(*[c for c in ("lang", "word", "u", "v") if c in out.columns]).distinct().count()))
        if name == "pairs":
            codes.append("codes" in out.columns)
        return out

    monkeypatch.setattr(collocations, "staged", counted)
    docs = spark.createDataFrame([("a b c d e f", "en")] * 400, "text string, lang string").repartition(3)
    assert collocations.collocations(docs).count() == 3
    assert [n for n, _ in keys] == [n for _, n in keys] == [6, 6, 5, 5, 4, 4, 3, 3] and codes == [True, True, False]


def shuffled(spark):
    """Rows and bytes that the session's stages have written for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in stages}


def test_op11_shuffles_a_row_a_chunk_and_bucket_and_not_one_a_key(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(600)])
    texts = [" ".join(words[rng.integers(0, 600, 200)]) for _ in range(1000)]
    docs = spark.createDataFrame([(x, "en") for x in texts], "text string, lang string").repartition(3)
    old = shuffled(spark)
    found = collocations.collocations(docs, least=3)
    assert found.count() == 2000
    new = [x for k, x in shuffled(spark).items() if k not in old]
    places = sum(len(x.split()) - 1 for x in texts)  # of pairs; some 80,000 a third of the texts, nearly all distinct there
    assert sum(rows for rows, _ in new) < places, new


def kept_tables(monkeypatch, *names):
    """What the operator stages under the names, kept on."""
    whole, tables = collocations.staged, {x: [] for x in names}

    def kept(df, name):
        out = whole(df, name)
        if name in tables:
            tables[name].append(out)
        return out

    monkeypatch.setattr(collocations, "staged", kept)
    monkeypatch.setattr(collocations, "discard", lambda df: None)
    return tables


def test_op11_has_more_buckets_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 2000, raising=False)
    tables, rows = kept_tables(monkeypatch, "words", "pairs"), [(t, x) for t, x in odd_texts() if x != "long"]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert phrases_of(collocations.collocations(docs, most=50)) == brute_phrases(rows, most=50)
    size = sum(len((x or "").encode()) for x, _ in rows)
    assert size > 4 * 2000  # and the session has 4 partitions
    for df in [*tables["words"], *tables["pairs"]]:
        assert {x for (x,) in df.select(F.size("counts")).distinct().collect()} == {-(-size // 2000)}


def test_op11_holds_few_chunks_that_are_written_or_read(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 500_000)
    tables = kept_tables(monkeypatch, "words")
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 75_000))) for _ in range(40)]
    assert collocations.collocations(spark.createDataFrame([(x, "en") for x in texts], "text string, lang string").coalesce(1)).count() == 0
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for df in tables["words"] for f in df.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(m.num_rows for m in files) == 40 and sum(sizes) > 30_000_000 and max(sizes) < 16_000_000, sizes


def test_op11_deals_chunks_to_more_tasks_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 500)
    tables = kept_tables(monkeypatch, "pairs")
    docs = spark.createDataFrame([("a b c d e f " * 20, "en")] * 100, "text string, lang string").repartition(3)
    assert collocations.collocations(docs).count() > 0
    for df in tables["pairs"]:
        assert df.count() > 20 and len(df.inputFiles()) > 8  # the session has 4 partitions


def test_op11_a_bucket_counts_its_keys():
    rng = np.random.default_rng(4)
    one = lambda x, kind: pa.array(x, pa.list_(kind))
    rows = [sorted({(int(u), int(v)) for u, v in rng.integers(0, 12, (60, 2))}) for _ in range(5)] + [[(2**31 - 2, 2**31 - 1)]] * 3
    n = [rng.integers(1, 9, len(x)).tolist() for x in rows]
    starts = [7 * i for i in range(len(rows))]
    met = pa.table({
        "lang": ["en"] * len(rows), "chunk": pa.array(range(len(rows)), pa.int64()), "us": one([[u for u, _ in x] for x in rows], pa.int32()),
        "vs": one([[v for _, v in x] for x in rows], pa.int32()), "counts": one(n, pa.int32()), "starts": pa.array(starts, pa.int32()),
    })
    f = collections.Counter()
    for x, m in zip(rows, n, strict=True):
        f.update(dict(zip(x, m, strict=True)))
    for least, placed in ((1, True), (12, True), (12, False), (10**6, True)):
        keys, *chunks = collocations._counter(["us", "vs"], least, placed, 16)((pa.scalar("en"), pa.scalar(5)), met).to_pylist()
        ids = dict(zip(zip(keys["us"], keys["vs"], strict=True), keys["ids"], strict=True))
        assert dict(zip(ids, keys["fs"], strict=True)) == {k: a for k, a in f.items() if a >= least} and keys["fs"] == sorted(keys["fs"], reverse=True)
        assert keys["chunk"] is None and sorted(ids.values()) == [16 * i + 5 for i in range(len(ids))]
        assert [(x["chunk"], list(zip(x["ats"], x["ids"], strict=True))) for x in chunks] == ([
            (i, [(starts[i] + j, ids[k]) for j, k in enumerate(x) if k in ids]) for i, x in enumerate(rows)
        ] if placed else [])


def test_op11_refuses_ids_that_are_too_large():
    met = pa.table({"lang": ["en"], "chunk": pa.array([0], pa.int64()), "words": [["a", "b"]], "counts": pa.array([[9, 9]], pa.list_(pa.int32())), "starts": pa.array([0], pa.int32())})
    with pytest.raises(pa.ArrowInvalid):
        collocations._counter(["words"], 1, True, 2**31)((pa.scalar("en"), pa.scalar(0)), met)


def test_op11_tiles_count_dense_and_sparse_alike():
    rng = np.random.default_rng(1)
    size = 1 << collocations.TILE
    for n, top in ((60_000, size), (5_000, 40 * size), (0, 1)):
        u, v = (np.minimum(rng.geometric(40 / top if top > 1 else 0.5, n) - 1, 70 * size).astype(np.int32) for _ in range(2))
        us, vs, counts, code = collocations.tiles(u, v)
        assert collections.Counter(zip(u.tolist(), v.tolist(), strict=True)) == dict(zip(zip(us.tolist(), vs.tolist(), strict=True), counts.tolist(), strict=True))
        assert (us[code] == u).all() and (vs[code] == v).all()


# ---- whitening


def brute_whitening(rows, most=16):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    w, q = np.linalg.eigh(c.T @ c / n)
    w, q = w[::-1][:most], q[:, ::-1][:, :most]
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(w), w / np.trace(c.T @ c / n)


def check_whitening(df, rows):
    ids, n, deviation, white, explained = brute_whitening(rows)
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.vec_id].append(r)
    assert set(got) == set(ids)
    k = white.shape[1]
    signs = None
    for i, d, w in zip(ids, deviation, white, strict=True):
        mine = sorted(got[i], key=lambda r: r.component)[:: len(got[i]) // k]
        assert [r.component for r in mine] == list(range(1, k + 1)) and {r.n for r in mine} == {n} and {r.deviation for r in mine} == {d}
        now = np.array([r.whitened for r in mine])
        signs = np.sign(now * w) if signs is None else np.where(signs == 0, np.sign(now * w), signs)
        assert np.allclose(now, w * np.where(signs == 0, 1, signs), atol=1e-8)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9) and mine[0].identity_error < 1e-9


def test_op12_is_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(whitening.op12_whitening(spark, SF), rows)


def test_op12_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "WIDE", 3)
    monkeypatch.setattr(whitening, "BLOCKS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(90)]
    rows += [(100 + i, rows[4][1]) for i in range(40)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [math.nan, *[1.0] * 4]), (204, [math.inf, *[1.0] * 4]), (205, [1.0, 2.0]), (206, [1e300, *[0.0] * 4])]
    table = spark.createDataFrame([(i, v, 7, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, i int, x int")
    check_whitening(whitening.whiten(table, "vec_id", "embedding"), rows)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same, "vec_id", "embedding").count() == 0
    assert whitening.whiten(same.limit(0), "vec_id", "embedding").count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.whiten(line, "vec_id", "embedding").select("component").distinct().count() == 1  # of rank one


def test_op12_deviations_beyond_longs_of_products(spark):
    rows = [(i, [float((-1) ** i * 2**40 * (i + 1)), float(i)]) for i in range(6)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()}
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    s = [sum(c) for c in zip(*x.values(), strict=True)]
    for i, v in x.items():
        exact = sum((6 * a - b) ** 2 for a, b in zip(v, s, strict=True))
        assert got[i] == (exact if exact < 2**63 else None)


# ---- urls


def brute_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")


def brute_rule(host, path, rules):
    fits = []
    for rule, verdict in rules:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            fits.append((-len(rule), rule, verdict))
    return min(fits)[1:] if fits else (None, None)


def brute_judge(rows, rules):
    """A tree grown by recursion, host by host."""
    items = []
    for page, url in rows:
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path, rules)
        words = re.split("[^a-z0-9]+", f"{host}/{path}".lower())
        bad = verdict == "block" if verdict else any(w in urls.BAD_WORDS for w in words)
        segs = [s for s in path.replace("*", "%2A").replace("{", "%7B").split("/") if s][: urls.DEPTH]
        items.append({"page": page, "host": host, "path": path, "rule": rule, "verdict": verdict, "bad": bad, "segs": segs})
    prior, out = sum(i["bad"] for i in items) / len(items), []

    def apart(a, n, b, m):
        both = (a + b) / (n + m)
        return (a / n - b / m) ** 2 > urls.ALIKE**2 * both * (1 - both) * (1 / n + 1 / m)

    def grow(own, depth, node, above):
        purity = (sum(i["bad"] for i in own) + urls.PRIOR * above) / (len(own) + urls.PRIOR)
        for i in own:
            if len(i["segs"]) <= depth:
                verdict = i["verdict"] or ("block" if purity > urls.REJECT else "allow")
                out.append((i["page"], i["host"], i["path"], i["rule"], verdict, i["host"] + (node or "/"), round(purity, 9)))
        deeper = [i for i in own if len(i["segs"]) > depth]
        counts = collections.Counter(i["segs"][depth] for i in deeper)
        kids = collections.defaultdict(list)
        for i in deeper:
            s = i["segs"][depth]
            kids[s if counts[s] >= urls.SUPPORT and counts[s] * urls.BRANCHES >= len(deeper) else "*"].append(i)
        stats = sorted((sum(i["bad"] for i in v) / len(v), sum(len(i["segs"]) == depth + 1 for i in v) / len(v), k) for k, v in kids.items())
        groups = []
        for p, e, k in stats:
            n = len(kids[k])
            if groups and not apart(p * n, n, last[0] * last[2], last[2]) and not apart(e * n, n, last[1] * last[2], last[2]):
                groups[-1].append(k)
            else:
                groups.append([k])
            last = (p, e, n)
        for g in groups:
            label = g[0] if len(g) == 1 else "{" + ",".join(sorted(g)) + "}"
            grow([i for k in g for i in kids[k]], depth + 1, f"{node}/{label}", purity)

    by_host = collections.defaultdict(list)
    for i in items:
        by_host[i["host"]].append(i)
    for own in by_host.values():
        grow(own, 0, "", prior)
    return sorted(out, key=repr)


def judged(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in df.collect()), key=repr)


def test_op13_is_brute_force(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    assert judged(urls.op13_urls(spark, "/root/testdata/sf0.01")) == brute_judge(rows, urls.RULES)


def odd_urls():
    rng = random.Random(6)
    rows = [(None, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.NET?x=1"), (5, "x://example.net/en/a"), (6, "x://Example.com/de/\n?q"), (7, "x://badexample.net/"), (8, "x://a.ORG/fr/../{a}*/b"), (8, "x://a.ORG/fr/../{a}*/b")]
    for i in range(600):
        kind = rng.choice(["news", "news", "shop", "casino", "tag"])
        tail = {"news": f"{rng.randrange(2000, 2004)}/{rng.randrange(9999)}", "shop": f"item-{rng.randrange(9999)}/reviews", "casino": f"{rng.randrange(999)}", "tag": rng.choice("abc")}[kind]
        rows.append((1000 + i, f"https://{rng.choice(['big.example.com', 'big.example.com', 'small.org', 'ads.example.com', 'xn.net'])}/{kind}/{tail}" + "/deep" * rng.choice([0, 0, 12])))
    return rows


def test_op13_odd_urls(spark):
    rows = odd_urls()
    pages = spark.createDataFrame([(*r, "h", "n", 1) for r in rows], "page_id long, url string, host string, node string, bad int").repartition(3)
    got = judged(urls.judge(pages, urls.RULES))
    assert got == brute_judge(rows, urls.RULES)
    verdicts = {(h, p.split("/")[1]): v for _, h, p, rule, v, *_ in got if rule is None and p.count("/") > 1}
    assert verdicts["big.example.com", "casino"] == "block" and verdicts["big.example.com", "news"] == "allow"  # by their templates
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0 and urls.judge(pages).filter("rule IS NOT NULL").count() == 0


def test_op13_runs_no_python(spark):
    plan = urls.judge(spark.createDataFrame([(1, "x://a/b")], "page_id long, url string"), urls.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- fixity of records without a file or a page


def test_op10_null_files_and_pages(spark):
    from cratelake.llm import fixity

    schema = "file long, seq long, page_id long, record binary"
    rows = [(f, i, None if i % 3 == 0 else i, f"record {i}".encode()) for f in (None, 1) for i in range(60)]
    left = spark.createDataFrame(rows, schema)
    assert fixity.audit(left, left).count() == 0
    worse = [(f, i, p, b"changed" if i in (6, 10) else r) for f, i, p, r in rows if i != 21]
    got = sorted(((r.file, r.page_id, r.status) for r in fixity.audit(left, spark.createDataFrame(worse, schema)).collect()), key=repr)
    assert got == sorted([(f, *x) for f in (None, 1) for x in ((10, "altered"), (None, "altered"), (None, "missing"))], key=repr)
    alone = spark.createDataFrame([(None, 0, 5, b"a")], schema)
    assert [tuple(r)[-1] for r in fixity.audit(alone, spark.createDataFrame([(None, 0, 5, b"b")], schema)).collect()] == ["altered"]
    assert [tuple(r)[-1] for r in fixity.audit(alone, alone.limit(0)).collect()] == ["missing"]
