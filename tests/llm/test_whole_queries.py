"""Registered queries over small tables against brute force: repeated rows, null ids, extra columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelake.llm import language, mixing, quality_model, quality_rules, sampling
from cratelake.llm.documents import Documents, unpacked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = [(7 * i, words(rng, 1 + i * 13 % 90), ["en", None][i % 2], ["a", "b", None, "c"][i % 4], 0) for i in range(120)]
    rows[5] = (35, None, "en", "a", 0)
    rows[6] = (42, "", "en", None, 0)
    rows[7] = (49, rows[8][1], "en", "a", 0)
    rows[9] = (63, "é☃𝄞 " * 9, "en", "b", 0)
    return rows


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("plain")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, rows, tmp_path_factory):
    """With null and repeated ids and repeated rows."""
    path = tmp_path_factory.mktemp("odd")
    more = [*rows, *[rows[3]] * 4, *[(None, *rows[20][1:])] * 3, (14, "another text of id 14", "en", "b", 0)]
    spark.createDataFrame(more, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path), more


def test_op1(spark, rows, table):
    got = {r["doc_id"]: r for r in sampling.op1_fingerprints(spark, table).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    off = []
    for i, (doc, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, "near_edited"), (after, "near_next")):
            a, b = collections.Counter(text.split()), collections.Counter(other.split())
            if a or b:
                off.append(r[near] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07
    assert got[49]["fingerprint"] == got[56]["fingerprint"]


def test_op1_rows_of_one_id_are_one_document(spark, odd):
    got = sampling.op1_fingerprints(spark, odd[0]).collect()
    ids = [r["doc_id"] for r in got]
    assert sorted(ids) == sorted({r[0] for r in odd[1] if r[0] is not None})
    assert next(r["n_chars"] for r in got if r["doc_id"] == 14) == len(min("another text of id 14", next(r[1] for r in odd[1] if r[0] == 14)))


def water(sizes):
    """Targets by weights 5, 2, 1 with a limit of 3 sizes, source by source until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)


@pytest.mark.parametrize("which", ["plain", "odd"])
def test_op2(spark, rows, table, odd, which):
    path, held = (table, rows) if which == "plain" else odd
    got = mixing.op2_mixing(spark, path).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((d, len((t or "").split())) for d, t, *_ in held)
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, _, s, _ in held:
        sizes[s] += len((t or "").split())
    target = water(sizes)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["draws"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in sizes)
    again = mixing.op2_mixing(spark, path).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


LANGS = {"en": "the and with from house green water over", "fr": "les des avec maison verte pour dans eau", "de": "der die und mit haus gruen wasser ueber"}


def test_op6(spark, tmp_path):
    rng, rows = random.Random(9), []
    for i in range(300):
        lang = list(LANGS)[i % 3]
        rows.append((i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(30)), lang if i % 7 else None))
    rows += [(400, None, "en"), (401, "12 34 !", "en"), (402, "", None), (None, rows[1][1], "fr"), (0, rows[0][1], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op6_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    # plain likelihoods of exact trigrams
    grams = lambda t: [f" {' '.join(t.split())} "[i : i + 3] for i in range(len(t) + 1)]
    count = {x: collections.Counter() for x in LANGS}
    for d, t, lang in rows:
        if lang and t and not out(d):
            count[lang].update(grams(t))
    score = lambda t, x: sum(math.log((count[x][g] + 0.1) / (sum(count[x].values()) + 3276.8)) for g in grams(t))
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t = text[r["doc_id"]]
        want = max(LANGS, key=lambda x: score(t, x)) if t and any(c.isalpha() for c in t) else "und"
        assert (r["lang_pred"], r["held_out"]) == (want, out(r["doc_id"])) and 0 <= r["score"] <= 1


def test_unknown_languages_surprise(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(LANGS["en"].split()) for _ in range(40)), "en") for i in range(50)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choice(LANGS["en"].split()) for _ in range(5)), "xkq zzvw qqpw jjxk wvuq kxzj " * 5]
    near, far = (r["surprise"] for r in language.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc.doc_id").collect())
    assert near < 1 < 4 < far


def test_op9(spark, tmp_path):
    rng, rows, labels = random.Random(2), [], []
    for i in range(200):
        good = i % 2
        rows.append((i, " ".join((f"w{rng.randrange(50)}" if good else f"{rng.randrange(10**5)}##") + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(20, 90)))))
        if i % 3:
            labels.append((i, good))
    rows += [(None, "no id"), (500, None), (501, ""), (3, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_model.op9_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    stat = lambda t: np.array(quality_model.statistics(t or ""))
    by = [np.array([stat(t) for d, t in rows for e, q in labels if d == e and q == k and not out(d)]) for k in (0, 1)]
    n = np.array([len(x) for x in by])
    cov = [np.cov(x.T, bias=True) for x in by]
    pooled = np.diag(sum(c * m for c, m in zip(cov, n, strict=True)).diagonal() / n.sum())
    cov = [0.9 * c + 0.1 * pooled + 0.05 * np.eye(len(pooled)) for c in cov]

    def density(x, k):
        d = x - by[k].mean(axis=0)
        return np.log(n[k] / n.sum()) - 0.5 * (np.linalg.slogdet(cov[k])[1] + d @ np.linalg.inv(cov[k]) @ d)

    text = dict(rows)
    for r in got:
        x = stat(text[r["doc_id"]])
        want = 1 / (1 + math.exp(-max(-40, min(40, (density(x, 1) - density(x, 0)) / 2))))
        assert math.isclose(r["score"], want, rel_tol=1e-6, abs_tol=1e-9)
        assert (r["predicted"], r["held_out"]) == (int(r["score"] >= 0.7), out(r["doc_id"]))


def test_op8_distances(spark):
    rng, rows = random.Random(6), []
    for i in range(60):
        lang = list(LANGS)[i % 3]
        rows.append((i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(60 + i)), lang))
    rows += [(100, "the and " * 30, "en"), (100, "the and " * 30, "en"), (101, " ".join(f"x{rng.randrange(10**6)}#" for _ in range(80)), None), (102, None, "en")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    # common-word references and distances by plain counting
    docs = [(x.split(), lang) for _, x, lang in rows if x and lang]
    vocabulary, q = {}, {}
    for lang in LANGS:
        mine = [ws for ws, x in docs if x == lang]
        n = collections.Counter(w for ws in mine for w in set(ws))
        vocabulary[lang] = sorted(n, key=lambda w: (-n[w], w))[:32]
        # of equal rows one counts
        once = list(dict.fromkeys(map(tuple, mine)))
        q[lang] = {w: sum(ws.count(w) / len(ws) for ws in once) / len(once) for w in vocabulary[lang]}

    def distance(p, r):
        half = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0
        return math.sqrt(max(0, sum(half(a, b) + half(b, a) for a, b in zip(p, r, strict=True)) / 2))

    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r["base_failed"]:
            assert not r["kept"]
            continue
        ws = text[r["doc_id"]].split()
        far = []
        for lang in LANGS:
            p = [ws.count(w) / len(ws) for w in vocabulary[lang]]
            far.append(distance([*p, 1 - sum(p)], [*q[lang].values(), max(0, 1 - sum(q[lang].values()))]))
        assert any(math.isclose(r["common_distance"], x, abs_tol=1e-6) for x in far)
    assert all(r["kept"] != r["base_failed"] for r in got if r["doc_id"] < 60) and sum(r["kept"] for r in got) > 20
    assert not next(r["kept"] for r in got if r["doc_id"] == 101)


def test_columns_of_any_name_pass(spark):
    names = ["doc_id", "text", "n_words", "n_removed", "out", "_spans", "_wanted", "_id", "doc", "_proof", "key", "more"]
    df = spark.createDataFrame([(1, "a b", *range(10)), (2, "c d", *range(10))], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    for rows in (df, df.unionByName(df)):
        d = Documents(rows)
        got = unpacked(d.without(spark.createDataFrame([], "doc_id long, start int, n_words int"), 20), names, text="out").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, rows.collect()))
