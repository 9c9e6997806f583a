"""SimHash near-duplicates found with BK-trees (operator 9).

Equal fingerprints are taken together first, so a group of exact copies is one fingerprint from
there on. Fingerprints that differ in few bits agree on at least one of `radius + 1` bands of bits
(pigeonhole), so each band value has a shard: a BK-tree over the fingerprints that share it, its
children keyed by their integer Hamming distance to the parent. A lookup follows only the edges
within the radius. A shard's fingerprints are looked up while the tree grows, and a shard reports a
spanning forest of its links, not all pairs, so a large group of near copies gives as many rows as
it has members. A shard that outgrows `shard_size` is cut into smaller ones by more bits: again by
the pigeonhole, over the bits outside the band. The forests' components are then found by min-label
propagation with pointer jumping.

The trees are not broadcast: together they are as large as the fingerprints, which has no bound.
Each is built where its shard's fingerprints meet and is dropped when the shard is done.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; texts with
fewer words than a shingle are hashed whole; repeated rows share a fingerprint and so a component;
rows with a null id have a fingerprint but can't name a component (the least non-null id does, or
null if there is none); an empty table gives an empty result. `keep_representatives` keeps the row of
the least id, nulls last, ties by a hash of the text, one of identical rows, and all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut, per_text, table

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: A shard with more fingerprints than this is cut by further bits.
SHARD_SIZE = 20_000
UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, width: int = SHINGLE) -> tuple[int]:
    """The 64 bits, as a signed long. A bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(UPPER).split()
    n = len(words)
    if not n:
        return (0,)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(whole[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n - width + 1
        )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return (int(bits.view(np.int64)[0]),)


def with_fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint as a signed long (an own column of that name is replaced)."""
    return docs.withColumn(into, per_text(fingerprint, "f long")(F.col(text_col))["f"])


class BKTree:
    """Integers under Hamming distance; a child hangs at its distance to the parent.

    top names the component of a member. A subtree whose members were all in one component when they came
    stays so, as components only merge; a lookup leaves such a subtree out once its value belongs to that
    component. So a large group of near copies costs a few visits for each of them, not one for each pair."""

    def __init__(self, top: Callable[[int], int]) -> None:
        self.top = top
        self.members: list[int] = []
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.uniform: list[bool] = []

    def add(self, member: int, value: int, radius: int, tie: Callable[[int, int], None]) -> None:
        """Ties the member to earlier ones within the radius, unless they are connected already, and hangs it in."""
        members, values, children, uniform, top = self.members, self.values, self.children, self.uniform, self.top
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            if uniform[at] and top(members[at]) == top(member):
                continue
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                tie(members[at], member)
            under = children[at]
            if len(under) > 2 * radius + 1:
                stack.extend(under[k] for k in range(d - radius, d + radius + 1) if k in under)
            else:
                stack.extend(c for k, c in under.items() if -radius <= k - d <= radius)
        new, own, at = len(values), top(member), 0
        while new:
            uniform[at] = uniform[at] and top(members[at]) == own
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = new
                break
            at = children[at][d]
        members.append(member)
        values.append(value)
        children.append({})
        uniform.append(True)


def bands(n_bands: int, bits: list[int] | None = None) -> list[int]:
    """Masks that cut the given bits into so many bands of nearly equal width."""
    bits = list(range(BITS)) if bits is None else bits
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n_bands)]


def forest(values: list[int], radius: int, shard_size: int, outside: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs that connect exactly what the links within the radius connect: a spanning forest."""
    parent = list(range(len(values)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    pairs: list[tuple[int, int]] = []

    def tie(a: int, b: int) -> None:
        x, y = top(a), top(b)
        if x != y:
            parent[y] = x
            pairs.append((values[a], values[b]))

    def grow(members: list[int], free: list[int]) -> None:
        if len(members) <= shard_size or len(free) <= radius:
            tree = BKTree(top)
            for member in members:
                tree.add(member, values[member], radius, tie)
            return
        for mask in bands(radius + 1, free):
            parts: dict[int, list[int]] = {}
            for member in members:
                parts.setdefault(values[member] & mask, []).append(member)
            rest = [b for b in free if not mask >> b & 1]
            for part in parts.values():
                if len({top(m) for m in part}) > 1:
                    grow(part, rest)

    grow(list(range(len(values))), list(range(BITS)) if outside is None else outside)
    return pairs


def _shards(radius: int, shard_size: int, masks: list[int]):
    """For mapInPandas over rows sorted by (band, shard): the links of each shard."""
    free = [[b for b in range(BITS) if not mask >> b & 1] for mask in masks]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held, out = None, [], []

        def finish() -> None:
            if len(held) > 1:
                out.extend(forest(held, radius, shard_size, free[held_key[0]]))

        for batch in batches:
            band, shard, prints = (batch[c].to_numpy() for c in ("band", "shard", "fingerprint"))
            edges = np.flatnonzero((band[1:] != band[:-1]) | (shard[1:] != shard[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(band)], strict=True):
                if a == b:
                    continue
                key = (int(band[a]), int(shard[a]))
                if key != held_key:
                    finish()
                    held_key, held = key, []
                held.extend(prints[a:b].view(np.uint64).tolist())
            if len(out) > 10_000:
                yield pd.DataFrame(np.array(out, np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])
                out.clear()
        finish()
        if out:
            yield pd.DataFrame(np.array(out, np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within the radius."""
    masks = bands(radius + 1)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("shard")) for i, m in enumerate(signed)])
    dealt = prints.select("fingerprint", F.explode(keys).alias("k")).select("k.band", "k.shard", "fingerprint")
    dealt = dealt.repartition("band", "shard").sortWithinPartitions("band", "shard", "fingerprint")
    return dealt.mapInPandas(_shards(radius, shard_size, masks), "a long, b long").distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fingerprint, component, root): the least `least` that can be reached over links (a, b), and its fingerprint.

    nodes: (fingerprint, least). Only linked nodes take part in the rounds; each round takes the
    least label around a node and then that label's own label, so labels travel twice as far each time."""
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    if both.isEmpty():
        return nodes.select("fingerprint", F.col("least").alias("component"), F.col("fingerprint").alias("root"))
    # Labels are fingerprints until the end, in the order of their least ids.
    linked = both.select(F.col("a").alias("fingerprint")).distinct()
    labels = cut(linked.join(nodes, "fingerprint").select("fingerprint", F.struct(F.col("least").isNull().alias("none"), "least", "fingerprint").alias("label")))
    while True:
        around = both.join(labels, both["b"] == labels["fingerprint"]).select(F.col("a").alias("fingerprint"), "label").unionAll(labels)
        new = around.groupBy("fingerprint").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("fingerprint").alias("_of"), F.col("label").alias("_further"))
        new = new.join(jump, F.col("label.fingerprint") == F.col("_of"), "left").select("fingerprint", F.least("label", F.coalesce("_further", "label")).alias("label"))
        new = cut(new)
        moved = new.join(labels.withColumnRenamed("label", "_old"), "fingerprint").filter(F.col("label") < F.col("_old"))
        done = moved.isEmpty()
        labels = new
        if done:
            break
    found = labels.select("fingerprint", F.col("label.least").alias("_found"), F.col("label.fingerprint").alias("_root"))
    component, root = F.coalesce("_found", "least").alias("component"), F.coalesce("_root", "fingerprint").alias("root")
    return nodes.join(found, "fingerprint", "left").select("fingerprint", component, root)


#: A key of more than one row in so many is hot; so there are at most so many hot keys.
HOT_SHARE = 2_000


def by_key(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts, one for each key with its number of rows `n`; the hot keys' facts, at most HOT_SHARE, are broadcast.

    So the rows of a large group stay where they are, and no task gets more than one row in HOT_SHARE by its key."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = facts["n"] * HOT_SHARE > total
    facts, many = facts.drop("n"), facts.filter(hot).drop("n")
    if many.isEmpty():
        return rows.join(facts, key)
    few = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(many), key).unionByName(few)


def classes(docs: DataFrame, key: str, text_col: str, radius: int) -> DataFrame:
    """(key, _hash of the text, fingerprint, component, root): one row for each row of docs."""
    read = docs.select(F.col(key).alias(key), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text"))
    printed = cut(with_fingerprint(read, "_text").select(key, "_hash", "fingerprint"))
    nodes = cut(printed.groupBy("fingerprint").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    found = components(nodes.select("fingerprint", "least"), near_links(nodes.select("fingerprint"), radius))
    return by_key(printed, cut(found.join(nodes.select("fingerprint", "n"), "fingerprint")), "fingerprint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint as a long, component_id): one row for each row of docs."""
    return classes(docs, key, text_col, radius).select(key, "fingerprint", F.col("component").alias("component_id"))


def keep_representatives(docs: DataFrame, key: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs, all columns, with one row of each component."""
    each = cut(classes(docs, key, text_col, radius).select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_hash").alias("hash")).alias("row"), "root"))
    best = cut(each.groupBy("root").agg(F.min("row").alias("best"), F.count("*").alias("n")))
    gone = cut(by_key(each, best, "root").filter(F.col("row") != F.col("best")).select(F.col("row.key").alias("_key"), F.col("row.hash").alias("_hash")).distinct())
    same = (docs[key].eqNullSafe(gone["_key"])) & (F.xxhash64(docs[text_col]) == gone["_hash"])
    kept = docs.join(gone, same, "left_anti")
    repeated = each.join(best, F.col("row") == F.col("best"), "left_semi").groupBy("row").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([key, text_col])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
