"""Sharding and mixing."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import mixing, sharding

SF = "/root/testdata/sf0.001"


def test_shards_hold_every_row_once(spark, odd, none):
    out = sharding.external_shuffle(odd, 3).collect()
    assert len(out) == odd.count()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert sorted(map(key, out)) == sorted(map(key, odd.collect()))
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == {0, 1, 2}
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    assert out[0]["_extra"] == {"k": "v"} and out[0]["size"] == 7
    assert sharding.external_shuffle(none, 3).count() == 0


def test_shuffle_uses_many_buckets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sharding.ROWS_PER_GROUP, old = 4, sharding.ROWS_PER_GROUP
    try:
        a, b = (sorted((r["position"], r["doc_id"]) for r in sharding.external_shuffle(docs.repartition(n), 8, bucket_bytes=20_000).collect()) for n in (1, 5))
    finally:
        sharding.ROWS_PER_GROUP = old
    assert a == b
    assert [d for _, d in a] != sorted(d for _, d in a)


def test_shard_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = sharding.op4_two_pass_shuffle(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(texts) and len(out) == len(texts)
    for r in out:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_offsets_over_blocks(spark):
    counts = spark.createDataFrame([(i, i % 5 + 1) for i in range(100)], "k long, n long")
    got = {r["k"]: r["offset"] for r in sharding.offsets(counts, "k", "n", width=7).collect()}
    assert got == {i: sum(j % 5 + 1 for j in range(i)) for i in range(100)}


def test_write_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sharding.write_shards(sharding.external_shuffle(docs, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def plain_targets(sizes, weights, cap):
    total, out, left = sum(sizes), {}, set(range(len(sizes)))
    rest = float(total)
    while left:
        per = rest / sum(weights[i] for i in left)
        over = {i for i in left if per * weights[i] > cap * sizes[i]}
        for i in over or left:
            out[i] = cap * sizes[i] if over else per * weights[i]
        rest -= sum(out[i] for i in over)
        if not over:
            break
        left -= over
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 50, 3], [0, 5], [0, 0], [100]])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 3)
    assert got == pytest.approx(plain_targets(sizes, weights, 3))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    assert sum(got) == pytest.approx(sum(sizes))


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    out = mixing.op7_mix_sources(spark, SF).collect()
    again = mixing.op7_mix_sources(spark, SF).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert {r["doc_id"]: r["size"] for r in out} == words and len(out) == len(words)
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(w for d, w in words.items() if source[d] == s) for s in names]
    want = dict(zip(names, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    for r in out:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[names.index(source[r["doc_id"]])]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for s, n in zip(names, sizes, strict=True):
        held = [r for r in out if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in held) - want[s]) <= 0.05 * want[s]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mix_equals_a_plain_systematic_sampler(spark, sf):
    """Document by document: sizes, order, prefix sums of expected copies, one offset for each source."""
    path = f"/root/testdata/sf{sf}/documents.parquet"
    hashed = spark.read.parquet(path).selectExpr("*", f"xxhash64({mixing.SEED}, doc_id) as card", "xxhash64(text) as tie", f"pmod(xxhash64({mixing.SEED + 1}, source), {1 << 20}) as draw")
    rows = [(r, len((r["text"] or "").encode().split())) for r in hashed.collect()]
    slices = max(1, -(-len(rows) // mixing.ROWS_PER_SLICE))
    names = sorted({r["source"] for r, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for r, n in rows if r["source"] == s) for s in names]
    want = {}
    for s, size, target in zip(names, sizes, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)):
        mine = sorted(((n, r) for r, n in rows if r["source"] == s), key=lambda x: (-x[0], x[1]["card"], x[1]["tie"]))
        long = [x for x in mine if x[0] * mixing.CERTAIN > target > 0]
        owed = 0.0
        for n, r in long:
            owed += n * target / size
            want[r["doc_id"]] = n * min(-int(-target / size // 1), max(int(target / size), int(owed / n + 0.5)))
            owed -= want[r["doc_id"]]
        rest = [x for x in mine if x not in long]
        words = sum(n for n, _ in rest)
        rate = min(3.0, max(0.0, (target - sum(want[r["doc_id"]] for _, r in long)) / words)) if words else 0.0
        rate = int(rate * 2**20) / 2**20
        rest.sort(key=lambda x: (int(mixing.CLASSES_PER_DOUBLING * np.log(x[0] + 1) / np.log(2)), x[1]["card"] % slices, -x[0], x[1]["card"], x[1]["tie"]))
        for i, (n, r) in enumerate(rest):
            offset = r["draw"] / 2**20
            want[r["doc_id"]] = n * (int((i + 1) * rate + offset) - int(i * rate + offset))
        # Half the smallest long document, or one class's spread of the others.
        assert abs(sum(want[r["doc_id"]] for _, r in mine) - target) <= max(0.03 * target, 0.5 * min((n for n, _ in long), default=0))
    got = {r["doc_id"]: r["taken"] for r in mixing.op7_mix_sources(spark, f"/root/testdata/sf{sf}").collect()}
    assert got == want


def test_mix_of_odd_rows(spark, odd, none):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == odd.count()
    assert {(r["source"], r["source_size"]) for r in out} == {("a", 32), ("b", 30), (None, 60_000)} or len({r["source"] for r in out}) == 3
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in out)
    emitted = mixing.emit(mixing.mix_sources(odd))
    assert emitted.count() == sum(r["copies"] for r in out)
    assert emitted.columns == [c for c in odd.columns if c not in mixing.OWN]
    assert all(r[c] == 7 for r in emitted.collect() for c in emitted.columns if c.startswith("_") and c != "_extra")
    assert mixing.mix_sources(none).count() == 0
