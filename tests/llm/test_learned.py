"""Toxicity, the quality classifier and the quality rules."""

import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality_classifier as qc
from tessera.llm import quality_rules as qr
from tessera.llm import toxicity as tox

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def small_index(n=300, seed=0):
    rng = np.random.default_rng(seed)
    words = {f"t{i}": i for i in range(60)}
    weight = rng.random(60) + 1
    vectors = []
    for _ in range(n):
        at = np.sort(rng.choice(60, rng.integers(0, 12), replace=False))
        vectors.append(tox.weighted(at, rng.integers(1, 5, len(at)).astype(float), weight))
    return tox.Index(words, weight, list(range(n)), rng.integers(0, 2, n), vectors, (1.0, 1.0)), vectors


@pytest.mark.parametrize(("block", "share"), [(1, 0.1), (8, 0.1), (64, 0.0), (8, 1.0)])
def test_block_max_search_is_exact(block, share, monkeypatch):
    monkeypatch.setattr(tox, "BLOCK", block)
    monkeypatch.setattr(tox, "COMMON_SHARE", share)
    index, vectors = small_index()
    place = {int(i): p for p, i in enumerate(index.ids)}
    dense = np.zeros((len(index.ids), 60))
    for i, (at, w) in enumerate(vectors):
        if i in place:
            dense[place[i], at] = w
    rng = np.random.default_rng(9)
    for _ in range(60):
        at = np.sort(rng.choice(60, rng.integers(1, 10), replace=False))
        w = rng.random(len(at))
        w /= np.sqrt(w @ w)
        q = np.zeros(60)
        q[at] = w
        cosine = dense @ q
        want = [p for p in np.lexsort((np.arange(len(cosine)), -cosine.round(9))) if cosine[p] > 0][: tox.NEAREST]
        where, got = index.nearest(at, w)
        assert list(where) == want and np.allclose(got, cosine[want])


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_texts_scored_together_score_as_alone(share, monkeypatch):
    monkeypatch.setattr(tox, "COMMON_SHARE", share)
    index, _ = small_index()
    index.vocabulary = {f"t{chr(97 + i // 26)}{chr(97 + i % 26)}".encode(): i for i in range(60)}
    rng, words = np.random.default_rng(4), [w.decode() for w in index.vocabulary]
    texts = ["", "unknown words"] + [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(2 * tox.BLOCK + 3)]
    together = index.scores(texts)
    assert together == [index.score(t) for t in texts] and together[:2] == [(index.bare, [])] * 2
    products = list(index.common([index.vector(t) for t in texts]))
    assert len(products) == len(texts) and not products[0].any()
    for text, product in zip(texts, products, strict=True):
        at, w = index.vector(text)
        query = np.zeros(index.dense.shape[1])
        query[index.column[at][index.column[at] >= 0]] = w[index.column[at] >= 0]
        assert np.abs(product - index.dense.astype(float) @ query).max() < tox.SLACK / 2


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "Ä", "ß", "İ", "_", "1", "٣", "“", " ", "\n", "ﬁ", "-", "é", "\u0301", "²", "漢"]), max_size=30).map("".join))
def test_words_as_bytes(text):
    assert tox.words_of(text) == [w.encode("utf-8", "surrogatepass") for w in tox.WORD.findall(text.lower())]


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0])
    knots = tox.isotonic(x, y, np.ones(5))
    assert np.allclose(np.interp([1, 2, 3, 4], *knots), [0, 0.5, 0.5, 0.5])


def test_toxicity_scores_recomputed(spark):
    """Every score of the query, from whole texts, by dense cosines over every word of every example."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    counts = {d: tox.terms(t) for d, t in docs.items()}
    words = sorted({w for d in y for w in counts[d]})
    n, m = sum(y.values()), len(y) - sum(y.values())
    held = [sum(w in c for c in counts.values()) for w in words]
    a = np.array([sum(w in counts[d] for d in y if y[d]) for w in words])
    b = np.array([sum(w in counts[d] for d in y if not y[d]) for w in words])
    llr = []
    for i, j in zip(a.tolist(), b.tolist()):
        p = (i + j) / (n + m)
        cells = [(i, n * p), (n - i, n * (1 - p)), (j, m * p), (m - j, m * (1 - p))]
        llr.append(2 * sum(x * np.log(x / e) for x, e in cells if x))
    weight = np.log((len(docs) + 1) / (np.array(held) + 1)) * np.maximum(1, np.sqrt(np.maximum(0, llr)))

    def vector(d):
        v = np.array([(1 + np.log(counts[d][w])) if w in counts[d] else 0 for w in words]) * weight
        return v / np.linalg.norm(v) if v.any() else v

    got = {r["doc_id"]: r for r in tox.op6_toxicity_nearest(spark, sf).collect()}
    index = tox.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    order = index.ids.tolist()  # cosines that tie go by position
    x, labels = np.array([vector(d) for d in order]), np.array([y[d] for d in order], float)
    rate = sum(y.values()) / len(y)

    def vote(cosine):
        top = [p for p in np.lexsort((np.arange(len(order)), -cosine.round(9))) if cosine[p] > 0][: tox.NEAREST]
        return (cosine[top] @ labels[top] + tox.PRIOR_WEIGHT * rate) / (cosine[top].sum() + tox.PRIOR_WEIGHT)

    among = x @ x.T
    np.fill_diagonal(among, 0)
    knots = tox.isotonic(np.array([vote(c) for c in among]), labels, np.ones(len(labels)))
    assert len(got) == len(docs)
    for d in docs:
        v = vector(d)
        if v.any():
            assert got[d]["score"] == pytest.approx(float(np.interp(vote(x @ v), *knots)), abs=1e-6), d
        else:
            assert got[d]["evidence"] == ""


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in tox.op6_toxicity_nearest(spark, SF).collect()}
    assert set(got) == set(docs)
    held = [(r, labels[d]["toxic"]) for d, r in got.items() if d in labels and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert np.mean([r["predicted"] == y for r, y in held]) >= 0.9


def test_toxicity_of_odd_rows(spark, odd, none):
    bad = "you utter scumbag you scumbag get lost scumbag"
    rows = [(i, f"{bad} number {i}" if i % 3 == 0 else f"a calm and friendly note about gardens number {i}") for i in range(100, 400)]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows] + [(1, None, None), (None, 1, 1), (3, 1, 0), (4, 0, 0), (4, 0, 0)], LABELS)
    index = tox.train(docs, labels)
    out = tox.with_toxicity(odd, index).collect()
    assert len(out) == odd.count() and all(0 <= r["toxicity"]["score"] < 0.5 for r in out) and out[0]["score"] == 0.5
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i % 3 == 0}
    none_labels = labels.limit(0)
    assert tox.drop_toxic(odd, none_labels).count() == odd.count()
    assert tox.drop_toxic(none, labels).count() == 0


def test_quality_held_out(spark, corpus):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in qc.op8_quality_classifier(spark, SF).collect()}
    assert set(got) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(r, labels[d]["quality"]) for d, r in got.items() if d in labels and r["held_out"]]
    assert np.mean([r["predicted"] == y for r, y in held]) >= 0.85


def test_class_prior_and_risk():
    rng = np.random.default_rng(4)
    pos = rng.normal(2, 1, (3_000, 2))
    unl = np.concatenate((rng.normal(2, 1, (3_600, 2)), rng.normal(-2, 1, (2_400, 2))))
    model = qc.Model.learn(pos, unl)
    assert abs(model.prior - 0.6) < 0.08
    assert (model.score(rng.normal(2, 1, (500, 2))) >= 0.5).mean() > 0.95
    assert (model.score(rng.normal(-2, 1, (500, 2))) < 0.5).mean() > 0.95


@pytest.mark.parametrize("true", [0.3, 0.6, 0.9])
@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_class_prior(true, seed):
    rng, n = np.random.default_rng(seed), int(6_000 * true)
    pos = rng.normal(2, 1, (3_000, 2))
    unl = np.concatenate((rng.normal(2, 1, (n, 2)), rng.normal(-2, 1, (6_000 - n, 2))))
    assert abs(qc.class_prior(pos, unl, np.random.default_rng(qc.SEED)) - true) < 0.08


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, None), (None, 1, 1)], LABELS)
    out = qc.with_quality(odd, qc.train(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in out)
    assert {r["quality_score"] for r in qc.with_quality(odd, qc.train(odd, labels.limit(0))).collect()} == {0.5}
    assert qc.with_quality(none, qc.train(none, labels)).count() == 0
    assert all(len(qc.features(t)) == qc.N_FEATURES for t in ("", " ", "a", "a b c\nd", "é" * 5))


def plain_rules(t):
    words = t.encode().split()
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cé", "#|", " ", "  ", "\n", "\t", "\x0b", " ", "\x1c"]), max_size=120).map("".join))
def test_rule_counts(text):
    assert qr.measure(text, qr.Limits({}, {}))[:6] == plain_rules(text)


def prose(rng, n):
    return " ".join("".join(chr(97 + int(x)) for x in (26 * rng.random(rng.integers(2, 9)) ** 2)) for _ in range(n))


def test_limits_follow_the_corpus(spark):
    """Most texts are prose of any length; noise and loops of the same lengths leave the bands, prose doesn't."""
    rng = np.random.default_rng(0)
    texts = [prose(rng, int(rng.integers(60, 2_000))) for _ in range(300)]
    noise = " ".join("".join(chr(33 + x) for x in rng.integers(0, 90, 9)) for _ in range(400))
    looped = " ".join(f"line {i % 7} of the same seven lines" for i in range(900))
    half = prose(rng, 900) + " " + " ".join("".join(chr(97 + x) for x in rng.integers(0, 2, 5)) for _ in range(2_000))
    docs = spark.createDataFrame(list(enumerate([*texts, noise, looped, half])), "doc_id long, text string")
    got = {r["doc_id"]: r["quality_rules"] for r in qr.with_quality_rules(docs).collect()}
    assert sum(not got[i]["kept"] for i in range(300)) <= 3
    assert (got[300]["kept"], got[300]["reason"]) == (False, "incompressible")
    assert not got[301]["kept"] and not got[302]["kept"] and not got[302]["base_failed"]
    assert got[0]["ratio"] == pytest.approx(len(zstandard.ZstdCompressor(level=qr.LEVEL).compress(texts[0].encode())) / len(texts[0].encode()))


def plain_limits(pairs):
    """Limits of each class from (bytes, packed bytes) by sorting, for comparison."""
    by = {}
    for n, packed in set(pairs):
        by.setdefault(int(4 * np.log2(n)), []).append(round(1000 * np.log(packed / n)))
    out = {}
    for c in range(qr.CLASSES):
        reach, held = 0, []
        while True:
            held = sorted(x for k, xs in by.items() if abs(k - c) <= reach for x in xs)
            if len(held) >= qr.LEAST_TEXTS or reach >= qr.CLASSES:
                break
            reach += 1
        if held:
            mid = held[(len(held) - 1) // 2]
            dev = sorted(abs(x - mid) for x in held)[(len(held) - 1) // 2]
            spread = max(qr.LEAST_SPREAD, 1.4826 * dev / 1000)
            out[c] = (np.exp(mid / 1000 - qr.WIDTH * spread), np.exp(mid / 1000 + qr.WIDTH * spread))
    return out


def test_verdicts_recomputed(spark, corpus):
    """Every text's verdict, from the whole texts, by plain sorting."""
    docs, labels = corpus
    packed = lambda b: len(zstandard.ZstdCompressor(level=qr.LEVEL).compress(b))
    data = {d: (t or "").encode() for d, t in docs.items()}
    parts = {d: [b[i : i + qr.CHUNK_BYTES] for i in range(0, len(b), qr.CHUNK_BYTES) if len(b) - i >= qr.LEAST_CHUNK] for d, b in data.items()}
    whole = plain_limits([(len(b), packed(b)) for b in data.values() if b])
    chunk = plain_limits([(len(p), packed(p)) for ps in parts.values() for p in ps])
    got = {r["doc_id"]: r for r in qr.op10_quality_rules(spark, SF).collect()}
    beyond = []
    for d, b in data.items():
        outside = len(b) > 0 and not whole[int(4 * np.log2(len(b)))][0] <= packed(b) / len(b) <= whole[int(4 * np.log2(len(b)))][1]
        bad = sum(not chunk[int(4 * np.log2(len(p)))][0] <= packed(p) / len(p) <= chunk[int(4 * np.log2(len(p)))][1] for p in parts[d])
        assert got[d]["kept"] == (not got[d]["base_failed"] and not outside and not (bad and bad >= qr.BAD_CHUNK_SHARE * len(parts[d]))), d
        if not got[d]["kept"] and not got[d]["base_failed"]:
            beyond.append(d)
    assert len(beyond) > 5
    assert sum(labels[d]["quality"] for d in beyond if d in labels) <= 1


def test_rules_of_odd_rows(spark, odd, none):
    out = qr.with_quality_rules(odd).collect()
    assert len(out) == odd.count() and all(r["kept"] for r in out) and out[0]["_class"] == 7
    assert [r["quality_rules"]["kept"] for r in out if r["doc_id"] in (3, 4, 5, 6, 7)] == [False] * 5
    assert qr.with_quality_rules(none).count() == 0


def test_rules_query_keeps_clean_prose(spark, corpus):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in qr.op10_quality_rules(spark, SF).collect()}
    for d, t in docs.items():
        r = got[d]
        if len(t) < 4_000:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(t)
    good = [got[d] for d, x in labels.items() if x["quality"] == 1]
    assert all(r["kept"] or r["base_failed"] for r in good)
