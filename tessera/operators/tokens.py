"""Tokens: pretoken counts, byte-pair training and encoding, offsets, windows, capped sampling, supervised rows."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.dedup import checkpointed

PRETOKEN = r"(?U)(\S+|\s+)"


def pretokens(text: Column) -> Column:
    """Runs of white space and of anything else."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN))


def pretoken_counts(df: DataFrame, text: str) -> DataFrame:
    """(pretoken, n)"""
    return df.select(F.explode(pretokens(F.col(text))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


def pair_counts(counted: DataFrame, symbols: str, weight: str) -> DataFrame:
    """(left, right, n): weighted adjacent pairs of the symbol arrays."""
    n = F.size(symbols)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.struct(F.try_element_at(F.col(symbols), i).alias("left"), F.try_element_at(F.col(symbols), i + 1).alias("right")))
    held = counted.filter(n >= 2).select(F.explode(pairs).alias("p"), weight)
    return held.groupBy("p.left", "p.right").agg(F.sum(weight).alias("n"))


class BytePairs:
    """Merges in training order over characters; special tokens never merge."""

    def __init__(self, merges: Sequence[tuple[str, str]], base: Sequence[str], special: Sequence[str] = ()) -> None:
        self.merges, self.special = list(merges), list(special)
        self.vocabulary = {t: i for i, t in enumerate(dict.fromkeys([*special, *sorted(base), *(a + b for a, b in merges)]))}
        self.ranks = {pair: i for i, pair in enumerate(self.merges)}
        self.cache: dict[str, list[str]] = {}

    @classmethod
    def train(cls, counted: Sequence[tuple[str, int]], size: int, special: Sequence[str] = ()) -> BytePairs:
        """Until the vocabulary has `size` entries or no pair is left: the pair with the highest count, ties to the least pair.

        Pair counts are kept up as pretokens change, so a merge costs what it touches."""
        words = [list(w) for w, _ in counted]
        weights = [n for _, n in counted]
        base = sorted({c for w in words for c in w})
        pairs: Counter = Counter()
        where: dict[tuple[str, str], set[int]] = {}
        for i, w in enumerate(words):
            for p in zip(w, w[1:], strict=False):
                pairs[p] += weights[i]
                where.setdefault(p, set()).add(i)
        merges: list[tuple[str, str]] = []
        while len(special) + len(base) + len(merges) < size:
            live = [p for p, n in pairs.items() if n > 0]
            if not live:
                break
            best = min(live, key=lambda p: (-pairs[p], p))
            merges.append(best)
            for i in where.pop(best, ()):
                old = words[i]
                new = merged(old, best)
                if len(new) == len(old):
                    continue
                for p in zip(old, old[1:], strict=False):
                    pairs[p] -= weights[i]
                for p in zip(new, new[1:], strict=False):
                    pairs[p] += weights[i]
                    where.setdefault(p, set()).add(i)
                words[i] = new
            pairs.pop(best, None)
        return cls(merges, base, special)

    def pieces(self, pretoken: str) -> list[str]:
        """The pretoken's tokens, lowest merge first."""
        if (held := self.cache.get(pretoken)) is not None:
            return held
        symbols = list(pretoken)
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.ranks.get(p, 1 << 60))
            if best not in self.ranks:
                break
            symbols = merged(symbols, best)
        if len(self.cache) < 1 << 18:
            self.cache[pretoken] = symbols
        return symbols

    def in_training_order(self, text: str) -> list[str]:
        """The whole text's tokens, each merge applied once over the stream, across spaces."""
        symbols = split_special(text, self.special)
        for pair in self.merges:
            symbols = merged(symbols, pair)
        return symbols

    def encode(self, text: str) -> list[int]:
        """Ids by pretoken; characters outside the vocabulary are an error."""
        import re

        out: list[int] = []
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                out.append(self.vocabulary[part])
            else:
                for p in re.findall(r"\S+|\s+", part):
                    out += [self.vocabulary[s] for s in self.pieces(p)]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        names = list(self.vocabulary)
        return "".join(names[i] for i in ids)

    def extended(self, characters: Sequence[str], special: Sequence[str]) -> BytePairs:
        """With ids for missing characters and special tokens behind the present ones."""
        out = BytePairs(self.merges, [], self.special)
        out.vocabulary = dict(self.vocabulary)
        for t in [*sorted(set(characters)), *special]:
            out.vocabulary.setdefault(t, len(out.vocabulary))
        out.special = [*self.special, *[s for s in special if s not in self.special]]
        return out

    def udf(self):
        """The encoder as a column function of texts."""
        held = self

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series([held.encode(t or "") for t in texts], dtype=object)

        return encode


def split_special(text: str, special: Sequence[str]) -> list[str]:
    """Characters, special tokens whole."""
    out, at = [], 0
    while at < len(text):
        hit = next((s for s in special if text.startswith(s, at)), text[at])
        out.append(hit)
        at += len(hit)
    return out


def merged(symbols: Sequence[str], pair: tuple[str, str]) -> list[str]:
    """Every non-overlapping pair as one symbol, from the left."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def next_merges(counts: dict[tuple[str, str], int], name: dict[str, str], room: int) -> list[tuple[str, str]]:
    """The next merges, at most `room`, in the order in which one after another would choose them: the pair with the highest
    count, ties to the least pair.

    More than one only where the first can't change the choice of the next: the next has no symbol of the pairs before
    it, so its count stays, and a count above all pairs with such symbols, so nothing new reaches it."""
    live = sorted((p for p, n in counts.items() if n > 0), key=lambda p: (-counts[p], name[p[0]], name[p[1]]))
    out: list[tuple[str, str]] = []
    used: set[str] = set()
    for k, p in enumerate(live[:room]):
        if used & set(p) or (out and any(counts[o] == counts[p] and used & set(o) for o in live[k + 1 :])):
            break
        out.append(p)
        if p[0] == p[1]:  # a run of one symbol pairs its merges among themselves
            break
        used |= set(p)
    return out


def train_byte_pairs(df: DataFrame, text: str, size: int, special: Sequence[str] = ()) -> BytePairs:
    """Byte pairs from all pretokens of a corpus, as BytePairs.train gives them.

    The pretokens stay distributed, each symbol as one character: a merge replaces two by a character that the corpus
    doesn't have. To the driver come the alphabet and the pair counts (at most size squared beside the alphabet's), then
    only their changes."""
    held = checkpointed(pretoken_counts(df, text).select(F.col("pretoken").alias("symbols"), F.col("n").alias("weight")))
    base = [r["c"] for r in held.select(F.explode(F.array_distinct(F.split("symbols", ""))).alias("c")).filter("c <> ''").distinct().collect()]
    name = {c: c for c in base}
    fresh = (chr(i) for i in range(0xF0000, 0x10FFFE) if chr(i) not in name)
    pairs = lambda rows: pair_counts(rows.withColumn("symbols", F.split("symbols", "")), "symbols", "weight")
    counts = Counter({(r["left"], r["right"]): r["n"] for r in pairs(held).collect()})
    merges: list[tuple[str, str]] = []
    rounds = 0
    while (room := size - len(special) - len(base) - len(merges)) > 0 and (best := next_merges(counts, name, room)):
        new = F.col("symbols")
        for a, b in best:
            merges.append((name[a], name[b]))
            name[c := next(fresh)] = name[a] + name[b]
            new = F.replace(new, F.lit(a + b), F.lit(c))
        after = held.withColumn("_new", new)
        moved = after.filter("_new <> symbols")
        change = moved.select(F.explode(F.array(F.struct(F.col("_new").alias("symbols"), "weight"), F.struct("symbols", (-F.col("weight")).alias("weight")))).alias("r")).select("r.*")
        for r in pairs(change).filter("n <> 0").collect():
            counts[r["left"], r["right"]] += r["n"]
        held, rounds = after.select(F.col("_new").alias("symbols"), "weight"), rounds + 1
        if rounds % 8 == 0:
            held = checkpointed(held)
    return BytePairs(merges, base, special)


def token_total(df: DataFrame, text: str, encode) -> DataFrame:
    """One row: the corpus's tokens, each distinct pretoken encoded once."""
    counted = pretoken_counts(df, text)
    return counted.select(F.sum(F.col("n") * F.size(encode(F.col("pretoken")))).alias("tokens"))


def characters(df: DataFrame, text: str) -> DataFrame:
    """(char, id): the sorted distinct characters of a corpus."""
    held = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char")).filter("char <> ''").distinct()
    return held.withColumn("id", F.row_number().over(W.orderBy("char")) - 1)


def offsets(df: DataFrame, pool: str, order: str, n: str) -> DataFrame:
    """df with `first` and `behind`: where each document's tokens lie in its pool's stream.

    The rows are cut into ranges of (pool, order), written once so that the cuts stay; the ranges' sums are summed up and
    rows only within their range, so no task holds a pool."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = checkpointed(df.repartitionByRange(parts, pool, order).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(pool).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.groupBy(pool, "_part").agg(F.sum(n).alias("_sum")).select(F.col(pool).alias("_pool"), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(n).over(W.partitionBy(pool, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    placed = held.withColumn("_inside", inside).join(F.broadcast(starts), F.col(pool).eqNullSafe(F.col("_pool")) & (F.col("_part") == F.col("_at")))
    return placed.withColumn("behind", (F.col("_start") + F.col("_inside")).cast("long")).withColumn("first", F.col("behind") - F.col(n)).drop("_part", "_inside", "_pool", "_at", "_start")


def windows(placed: DataFrame, pool: str, key: str, span: int, stride: int) -> DataFrame:
    """(pool, window, key, tokens): the targets that each document gives to each full window of the pool's stream.

    Window w reads positions [w * stride, w * stride + span) and predicts all but the first. The windows that a
    document meets are a range of numbers, so no join is needed."""
    total = placed.groupBy(pool).agg(F.max("behind").alias("_total"))
    held = placed.join(total, pool)
    last = F.floor((F.col("_total") - span) / stride)
    first = F.greatest(F.lit(0), F.floor((F.col("first") - span) / stride) + 1)
    until = F.least(last, F.floor((F.col("behind") - 1) / stride))
    held = held.withColumn("window", F.explode(F.when(until >= first, F.sequence(first.cast("long"), until.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    begin = F.col("window") * stride + 1
    tokens = F.least("behind", begin + span - 1) - F.greatest("first", begin)
    return held.select(pool, "window", key, tokens.alias("tokens")).filter("tokens > 0")


def continuation_windows(n: Column, context: int, block: int) -> Column:
    """(start, stop, label_start): blocks of labels, each with bounded context to its left."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block)), lambda i: F.struct(F.greatest(F.lit(0), i * block - context).alias("start"), F.least(n.cast("long"), (i + 1) * block).alias("stop"), (i * block).alias("label_start"))))


def capped_sample(contributions: DataFrame, component: str, window: str, caps: dict[str, float], count: int, salt: str) -> DataFrame:
    """(component, window, draw, cycle): `count` draws of windows in hash order, again and again, skipping those that
    would lift a group's share of all targets above its cap. Infeasible caps are an error.

    contributions: (component, window, tokens and one column for each capped group). A fold over one component."""
    groups = list(caps)
    kinds = dict(contributions.dtypes)
    schema = f"{component} {kinds[component]}, {window} {kinds[window]}, draw int, cycle int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {w: g for w, g in pdf.groupby(window)}
        order = sorted(by, key=lambda w: hashlib.sha256(f"{salt}:{w}".encode()).hexdigest())
        span = max(int(g["tokens"].sum()) for g in by.values())
        limit = {g: caps[g] * count * span for g in groups}
        used: Counter = Counter()
        out, cycle = [], 0
        while len(out) < count:
            drawn = 0
            for w in order:
                if len(out) == count:
                    break
                adds: Counter = Counter()
                for g in groups:
                    for name, n in by[w].groupby(g)["tokens"].sum().items():
                        adds[g, name] += int(n)
                if all(used[k] + n <= limit[k[0]] for k, n in adds.items()):
                    used.update(adds)
                    out.append((pdf[component].iloc[0], w, len(out) + 1, cycle))
                    drawn += 1
            if not drawn:
                raise ValueError(f"the caps leave only {len(out)} of {count} draws")
            cycle += 1
        return pd.DataFrame(out, columns=[component, window, "draw", "cycle"])

    return contributions.groupBy(component).applyInPandas(fold, schema)


def supervised(prompt: Column, answer: Column, end: int) -> Column:
    """(input_ids, labels): the prompt's labels are -100."""
    ids = F.concat(prompt, answer, F.array(F.lit(end)))
    return F.struct(ids.alias("input_ids"), F.concat(F.transform(prompt, lambda _: F.lit(-100)), answer, F.array(F.lit(end))).alias("labels"))


def selected_frequency(df: DataFrame, tokens: str, ids: Sequence[int]) -> DataFrame:
    """(token, n) of the given ids, zeros kept."""
    want = df.sparkSession.createDataFrame([(i,) for i in ids], "token int")
    got = df.select(F.explode(tokens).alias("token")).filter(F.col("token").isin(*ids)).groupBy("token").agg(F.count("*").alias("n"))
    return want.join(got, "token", "left").select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def bounded_shards(df: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """df with `shard`, `start`, `stop`: items in order into shards of at most `limit` bytes, one byte between items.

    A sequential fold over (order, size) only; an item above the limit is an error."""
    kinds = dict(df.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, shard, at = [], 0, 0
        for k, n in sorted(zip(pdf[order], pdf[size], strict=True)):
            if n > limit:
                raise ValueError(f"item {k} has {n} bytes; a shard holds {limit}")
            start = at + (1 if at else 0)
            if start + n > limit:
                shard, start = shard + 1, 0
            at = start + n
            out.append((k, shard, start, at))
        return pd.DataFrame(out, columns=["_k", "shard", "start", "stop"])

    placed = df.select(order, size).groupBy().applyInPandas(fold, f"_k {kinds[order]}, shard int, start long, stop long")
    return df.join(placed, F.col(order) == F.col("_k")).drop("_k")


def character_ids(text: Column, vocabulary: dict[str, int]) -> Column:
    """Ids of a text's characters; null for characters outside the vocabulary."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: table[c])


def dataset(df: DataFrame, text: str, encode, fraction: float) -> DataFrame:
    """df with train and validation token arrays; each document keeps its tail for validation."""
    from tessera.operators.split import tail_tokens

    return df.withColumn("tokens", encode(F.col(text))).withColumn("parts", tail_tokens(F.col("tokens"), fraction)).filter("parts is not null").select("*", "parts.train", "parts.validation").drop("parts", "tokens")


def dataset_report(df: DataFrame, by: str) -> DataFrame:
    """Documents and tokens of each part."""
    return df.groupBy(by).agg(F.count("*").alias("documents"), F.sum(F.size("train")).alias("train_tokens"), F.sum(F.size("validation")).alias("validation_tokens"))


def register(spark, name: str, pairs: BytePairs) -> None:
    """Makes an encoder callable from SQL."""
    spark.udf.register(name, pairs.udf())


def stream_text(df: DataFrame, order: str, text: str, separator: str, most: int = 10_000) -> str:
    """A small corpus as one text; more rows than `most` are an error."""
    rows = df.select(order, text).orderBy(order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return separator.join(r[text] for r in rows)
