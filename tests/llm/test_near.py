"""SimHash with BK-trees and benchmark decontamination."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessera.llm import decontaminate as dc
from tessera.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_print(t):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    top = {k: k for k in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                if x != y:
                    top[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉé \n\t \x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text)[0] & (1 << 64) - 1 == plain_print(text)


def test_forest_connects_what_links_connect():
    rng = random.Random(3)
    for shard_size in (4, 1_000):
        values = [0]
        for _ in range(300):
            v = rng.choice(values) if rng.random() < 0.6 else rng.getrandbits(64)
            for _ in range(rng.randrange(7)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
        values = sorted(set(values))
        pairs = simhash.forest(values, 4, shard_size)
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs) and len(pairs) < len(values)
        want = plain_components(dict(enumerate(values)))
        top = {v: v for v in values}

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[find(a)] = find(b)
        groups = lambda f: sorted(sorted(i for i in range(len(values)) if f(i) == k) for k in {f(i) for i in range(len(values))})
        assert groups(lambda i: find(values[i])) == groups(lambda i: want[i])


def test_a_hot_shard_is_spanned():
    """Thousands of fingerprints within the radius of one, above and below the size at which a shard is cut."""
    rng = random.Random(1)
    centre, values = rng.getrandbits(64), set()
    while len(values) < 3_000:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(13, 64), rng.randrange(5))))
    values = sorted(values | {centre})
    for shard_size in (500, 20_000):
        assert len(simhash.forest(values, 4, shard_size)) == len(values) - 1


def test_a_large_group_of_near_copies_gives_few_links(spark):
    rng = random.Random(5)
    prints = {0}
    while len(prints) < 400:
        prints.add(sum(1 << rng.randrange(40) for _ in range(2)) & (1 << 63) - 1)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    links = simhash.near_links(df)
    assert links.count() <= 5 * len(prints)
    nodes = df.selectExpr("fingerprint", "fingerprint as least")
    assert {r["component"] for r in simhash.components(nodes, links).collect()} == {min(prints)}


def test_near_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {k: plain_print(t) for k, t in texts.items()}
    want = plain_components(prints)
    got = {r["doc_id"]: r for r in simhash.op9_simhash_near_dedup(spark, SF).collect()}
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{prints[k]:016x}", want[k]) for k in texts}


def test_near_duplicates_of_odd_rows(spark, odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] in (3, 4, 5)} == {3}
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_representatives(none).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (None, "c d")], "doc_id long, text string")
    assert simhash.keep_representatives(twice).count() == 2


def plain_search(pattern, stretch):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in stretch:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=25))
def test_edit_search(pattern, stretch):
    edits, start, end = dc.nearest(pattern, stretch)
    assert edits == plain_search(pattern, stretch)
    assert plain_search(pattern, stretch[start:end]) == edits


def planted(seed=1, rates=(0.0, 0.05, 0.1, 0.15, 0.19)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    draw = lambda n: [words[int(900 * rng.random() ** 3)] for _ in range(n)]
    items = [(i, draw(rng.randrange(8, 90))) for i in range(80)]
    texts, want = [], []
    for i, item in items:
        for rate in rates:
            held = list(item)
            for _ in range(int(rate * len(held))):
                at, what = rng.randrange(len(held)), rng.randrange(3)
                if what == 0:
                    held[at] = "other"
                elif what == 1:
                    held.insert(at, "more")
                else:
                    del held[at]
            texts.append(" ".join([*draw(rng.randrange(0, 200)), *held, *draw(rng.randrange(0, 200))]))
            want.append(i)
    return [(i, " ".join(x)) for i, x in items], texts, want, draw


def test_recall_and_precision_against_brute_force():
    items, texts, want, draw = planted()
    clean = [" ".join(draw(400)) for _ in range(60)]
    found = dc.Index(items).search(texts + clean)
    # best_end is held against plain_search above; here it tries every item on every text.
    brute = [{i for i, x in items if dc.best_end(x.split(), t.split())[0] <= dc.allowed(len(x.split()))} for t in texts + clean]
    got = [{h["item"] for h in hits} for hits in found]
    assert all(g <= b for g, b in zip(got, brute, strict=True)), "what is found is verified"
    total = sum(map(len, brute))
    assert total >= len(texts) * 0.95
    assert sum(map(len, got)) >= 0.98 * total


def test_positions_and_edits():
    item = "one two three four five six seven eight nine ten"
    text = "x, y. One two THREE four five-six seven eight! nine ten; z"
    ((hit,),) = dc.Index([(7, item)]).search([text])
    assert (hit["item"], hit["edits"], hit["item_words"]) == (7, 0, 10)
    assert text[hit["start"] : hit["stop"]] == "One two THREE four five-six seven eight! nine ten"


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, None), (3, ""), (4, "too short"), (None, "word5 stone river word6 stone river word7 stone river")], "item_id long, text string")
    out = dc.find_items(odd, bench).select("doc_id", "hits").collect()
    assert len(out) == odd.count()
    for r in out:
        assert [h["item"] for h in r["hits"]] == ([1] if r["doc_id"] in (1, 2) else [None] if r["doc_id"] == 7 else [])
    kept = dc.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert dc.find_items(none, bench).count() == 0
    assert dc.drop_contaminated(odd, bench.limit(0)).count() == odd.count()


def test_benchmark_in_parts(spark):
    items, texts, want, _ = planted(2, (0.0, 0.1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    dc.INDEX_WORDS, old = 1_000, dc.INDEX_WORDS
    try:
        got = {r["doc_id"]: {h["item"] for h in r["hits"]} for r in dc.find_items(docs, bench).collect()}
    finally:
        dc.INDEX_WORDS = old
    assert sum(w in got[d] for d, w in enumerate(want)) >= 0.98 * len(want)


def test_many_words_share_bits_by_class():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 60_000, 40))) for i in range(2_000)]
    index = dc.Index(items)
    assert all(c.bits.shape[1:] == (c.steps, dc.WORD_CLASSES) for c in index.classes)
    found = index.search([items[5][1], "nothing here at all but words"])
    assert [h["item"] for h in found[0]] == [5] and found[1] == []


def test_recall_at_the_limit():
    items, texts, _, _ = planted(3, (0.2, 0.2))
    brute = [{i for i, x in items if dc.best_end(x.split(), t.split())[0] <= dc.allowed(len(x.split()))} for t in texts]
    got = [{h["item"] for h in hits} for hits in dc.Index(items).search(texts)]
    assert sum(map(len, brute)) >= 0.95 * len(texts)
    assert sum(map(len, got)) >= 0.98 * sum(map(len, brute))


def test_items_named_by_text(spark):
    """Item keys keep their type, in one part and in several; a clashing input column stays."""
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x {words} y", 5), (2, None, 5), (3, "nothing", 5), (1, f"x {words} y", 5)], "doc_id long, text string, _hits int")
    bench = spark.createDataFrame([("a-1", words), ("b-2", " ".join(f"v{i}" for i in range(30)))], "item_id string, text string")
    for size in (dc.INDEX_WORDS, 30):
        dc.INDEX_WORDS, old = size, dc.INDEX_WORDS
        try:
            got = dc.find_items(docs, bench).collect()
            kept = dc.drop_contaminated(docs, bench)
            assert kept.columns == docs.columns and [(r["doc_id"], r["_hits"]) for r in kept.orderBy("doc_id").collect()] == [(2, 5), (3, 5)]
        finally:
            dc.INDEX_WORDS = old
        assert sorted((r["doc_id"], [h["item"] for h in r["hits"]]) for r in got) == [(1, ["a-1"]), (1, ["a-1"]), (2, []), (3, [])]


def test_hot_keys_are_joined_where_they_lie(spark):
    rows = spark.range(6_000).selectExpr("id", "case when id % 3 = 0 then 7L else id end as k")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = simhash.by_key(rows, facts, "k")
    assert got.count() == 6_000 and got.filter("k = 7").select("least").distinct().count() == 1
    assert {r["least"] for r in got.filter("k <> 7").collect()} == {i for i in range(6_000) if i % 3 and i != 7}
    assert simhash.by_key(rows.limit(0), facts.limit(0), "k").count() == 0
