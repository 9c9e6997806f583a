"""Benchmark decontamination by CGK embedding and bit sampling (operator 2).

Texts are compared as sequences of lower-case words. A document holds an item if some stretch of it
is within an edit distance of a fifth of the item's words. The CGK walk reads a window left to right
and, at each step, moves on or stays by a random bit of the step and the word (its class) it stands on; two
windows a few edits apart soon walk in step again, so their embeddings differ in few places
(Hamming). Sampling a few places of the embedding gives a bucket key, and enough repetitions with
other random bits reach the target recall. How many that takes is measured when the index is built, on windows of
the items themselves with edits planted at the limit. A class that misses the target at `MAX_REPEATS` (long items do: the
walks drift apart) is not walked but searched exactly: an edit breaks at most q of an item's word q-grams, so a stretch within
the limit still holds a known number of them, and every stretch that does is verified.

Items are put into length classes, and each class has windows of its size at every word of every
document. Before a window is embedded, its words are counted against the words of the class's items:
fewer than the edit distance leaves means no item can match, so no match is lost (a running sum for
each class over the whole text). What the buckets give is verified exactly, by bit-parallel edit
distance against the stretch of the document around it.

The index lives in the tasks' closures. A benchmark over `INDEX_WORDS` words is cut into parts by hash of
the item, and each part makes its own pass, which writes what the texts hold, by their SHA-256, before the next begins; so neither
the driver nor a task holds more than one part.

Defined cases: null or empty documents hold nothing; null or empty items and items of fewer than
`LEAST_WORDS` words match nothing; items with the same words are found each; repeated rows are
answered each; an empty table on either side gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, cut, own, table

TOKEN = re.compile(r"[^\W_]+")
LEAST_WORDS = 5
#: Edits allowed, as a share of the item's words: a similarity of 0.8 or more.
EDIT_SHARE = 0.2
TARGET_RECALL = 0.98
SAMPLED = 3
MIN_REPEATS, MAX_REPEATS = 8, 40
#: Longest grams of the exact search, and how many (place, item) rows it holds at once, but for a single document's.
LONGEST_GRAM, GRAM_ROWS = 4, 1_000_000
#: Words are dealt into so many classes (a power of two); the walk's random bit goes by the step and the word's class.
WORD_CLASSES = 512
LARGEST_WINDOW = 512
INDEX_WORDS = 2_000_000
#: Windows whose words are held at once.
WINDOW_ROWS = 50_000
CHUNK_WORDS = 500_000
SEED = 99
HITS = "array<struct<item:string,edits:int,item_words:int,start:int,stop:int>>"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    low = text.lower()
    if len(low) == len(text):
        return TOKEN.findall(low)
    return [w.lower() for w in TOKEN.findall(text)]


def allowed(n_words: int) -> int:
    """Edits allowed for an item of so many words."""
    return int(EDIT_SHARE * n_words)


def window_sizes() -> list[int]:
    """Sizes of the length classes, each about a quarter over the one before."""
    sizes = [LEAST_WORDS]
    while sizes[-1] < LARGEST_WINDOW:
        sizes.append(min(LARGEST_WINDOW, max(sizes[-1] + 1, int(sizes[-1] * 1.25))))
    return sizes


def best_end(pattern: Sequence[int], stretch: Sequence[int]) -> tuple[int, int]:
    """(edits, end): the stretch's substring nearest the pattern, the earliest end of the nearest (bit-parallel)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    every, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = every, 0, m, m, 0
    for j, w in enumerate(stretch):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & every
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & every, mh << 1 & every
        pv = mh | ~(xv | ph) & every
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def nearest(pattern: Sequence[int], stretch: Sequence[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the substring nearest the pattern."""
    edits, end = best_end(pattern, stretch)
    back = list(reversed(stretch[:end]))[: len(pattern) + edits]
    _, length = best_end(pattern[::-1], back)
    return edits, end - length, end


class LengthClass:
    """The items of one window size: their words, their embedded windows by bucket key."""

    def __init__(self, size: int, items: list[np.ndarray], numbers: list[int], n_words: int, rng: np.random.Generator) -> None:
        self.size, self.items, self.numbers = size, items, numbers
        self.known = np.zeros(n_words + 2, np.uint8)
        for item in items:
            self.known[item] = 1
        self.least = max(1, size - allowed(max(map(len, items))))
        longest = max(map(len, items))
        self.padding = allowed(longest) + longest - size
        self.steps = 7 * size // 4  # the walk is inside the window for about twice its size; later places say nothing
        # Every window of every item; their words are looked up a block at a time.
        words, held = np.concatenate(items), np.array([len(i) for i in items])
        n_windows = held - size + 1
        owners = np.repeat(np.arange(len(items)), n_windows)
        offsets = np.arange(len(owners)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        at = (np.cumsum(held) - held)[owners] + offsets
        windows = lambda some: words[some[:, None] + np.arange(size)]
        self.bits = rng.integers(0, 2, (MAX_REPEATS, self.steps, WORD_CLASSES), np.uint8)
        self.places = np.sort(np.stack([rng.choice(self.steps, min(SAMPLED, self.steps), replace=False) for _ in range(MAX_REPEATS)]), axis=1)
        self.mix = rng.integers(1, 1 << 62, (MAX_REPEATS, self.places.shape[1]), np.int64) | 1
        self.symbol = rng.integers(0, 1 << 62, n_words + 3, np.int64)
        self.repeats = self.measured(windows(at[rng.integers(0, len(at), 200)]), rng)
        self.tables = []
        for r in range(self.repeats):
            keys = np.concatenate([self.keys(windows(at[a : a + WINDOW_ROWS]), r) for a in range(0, len(at), WINDOW_ROWS)])
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], owners[order], offsets[order]))
        self.bits = self.bits[: self.repeats].copy()
        if not self.repeats:
            self.index_grams(rng)

    def index_grams(self, rng: np.random.Generator) -> None:
        """For the exact search: the distinct word grams of each item, and how many of them its edit limit leaves."""
        sizes = np.array([len(i) for i in self.items])
        limits = np.array([allowed(n) for n in sizes.tolist()])
        self.gram = q = min(LONGEST_GRAM, int((sizes // (limits + 1)).min()))
        self.left = sizes - q + 1 - q * limits  # at least 1, as q pieces of limit + 1 fit the item
        self.reach = sizes + limits
        self.gram_mix = rng.integers(1, 1 << 62, q, np.int64) | 1
        keys = [np.unique(self.gram_keys(i)) for i in self.items]
        owners, keys = np.repeat(np.arange(len(keys)), list(map(len, keys))), np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.posted = keys[order], owners[order]

    def gram_keys(self, ids: np.ndarray) -> np.ndarray:
        """A hash of the gram at each place; equal hashes of unlike grams only cost a verification."""
        n = len(ids) - self.gram + 1
        return sum(self.symbol[ids[j : j + n]] * self.gram_mix[j] for j in range(self.gram))

    def keys(self, windows: np.ndarray, r: int) -> np.ndarray:
        """The bucket keys of the windows in repetition r: the sampled places of their CGK embeddings."""
        n, size = windows.shape
        end = len(self.symbol) - 1
        padded = np.concatenate((windows, np.full((n, 1), end, windows.dtype)), axis=1)
        at, rows = np.zeros(n, np.int64), np.arange(n)
        key, taken, places = np.zeros(n, np.int64), 0, self.places[r]
        for j in range(int(places[-1]) + 1):
            here = padded[rows, at]
            while taken < len(places) and places[taken] == j:
                key += self.symbol[here] * self.mix[r, taken]
                taken += 1
            at += (self.bits[r, j, here & (WORD_CLASSES - 1)] != 0) & (here != end)
        return key

    def measured(self, some: np.ndarray, rng: np.random.Generator) -> int:
        """Repetitions that reach the target recall on some windows with edits planted at the limit; 0 if MAX_REPEATS miss it."""
        edits = max(1, allowed(self.size))
        changed = np.empty_like(some)
        for k, w in enumerate(some):
            w = list(w)
            for _ in range(edits):
                what, at = rng.integers(3), int(rng.integers(len(w)))
                if what == 0:
                    w[at] = 0
                elif what == 1:
                    w.insert(at, 0)
                else:
                    del w[at]
            changed[k] = (w + [0] * edits)[: self.size]
        missed = np.ones(len(some), bool)
        for r in range(MAX_REPEATS):
            missed &= self.keys(some, r) != self.keys(changed, r)
            if r + 1 >= MIN_REPEATS and missed.mean() <= 1 - TARGET_RECALL:
                return r + 1
        return 0

    def candidates(self, ids: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """(document, item, start of the item) for windows whose bucket holds an item."""
        size = self.size
        if len(ids) < size:
            return np.empty((0, 3), np.int64)
        sums = np.concatenate(([0], np.cumsum(self.known[ids], dtype=np.int32)))
        starts = np.flatnonzero((sums[size:] - sums[:-size] >= self.least) & (doc_of[size - 1 :] == doc_of[: len(ids) - size + 1]))
        found = []
        for a in range(0, len(starts), WINDOW_ROWS):
            part = starts[a : a + WINDOW_ROWS]
            windows = ids[part[:, None] + np.arange(size)]
            for r, (keys, owners, offsets) in enumerate(self.tables):
                got = self.keys(windows, r)
                low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                counts = (high - low)[hit]
                which = np.repeat(hit, counts)
                entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hit], counts)
                found.append(np.stack((doc_of[part[which]], owners[entry], part[which] - offsets[entry]), axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def walked(self, ids: np.ndarray, doc_of: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, low, high): the stretches of documents around what the buckets give."""
        done: dict[tuple[int, int], int] = {}
        for d, k, start in self.candidates(ids, doc_of).tolist():
            limit = allowed(len(self.items[k]))
            at = start - int(first[d])
            if at - limit < done.get((d, k), -1 << 40):  # inside what was verified, but for its last part
                continue
            yield d, k, max(0, at - limit - 2), at + len(self.items[k]) + 3 * limit + 8
            done[d, k] = at + limit + 4

    def counted(self, ids: np.ndarray, doc_of: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, low, high): every stretch that holds as many of an item's grams as its edit limit leaves.

        Such grams of a match lie at places within its reach, so a match lies between the reach before the last of them and
        the reach behind the first. Stretches of an item that overlap come as one."""
        q, (posted, owners) = self.gram, self.posted
        if len(ids) < q:
            return
        got = self.gram_keys(ids)
        from_, to = np.searchsorted(posted, got, "left"), np.searchsorted(posted, got, "right")
        hit = np.flatnonzero((to > from_) & (doc_of[q - 1 :] == doc_of[: len(got)]))
        counts, docs = (to - from_)[hit], doc_of[hit]
        total, a = np.cumsum(counts), 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(total, total[a] - counts[a] + GRAM_ROWS, "right")))
            b = int(np.searchsorted(docs, docs[b - 1], "right"))  # whole documents
            n = counts[a:b]
            item = owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(from_[hit[a:b]], n)]
            place = np.repeat(hit[a:b], n)
            order = np.argsort(item, kind="stable")
            item, place = item[order], place[order]
            last = np.arange(len(item)) + self.left[item] - 1
            enough = last < len(item)
            last = np.minimum(last, len(item) - 1)
            doc = doc_of[place]
            enough &= (item[last] == item) & (doc[last] == doc) & (place[last] + q - place <= self.reach[item])
            k, d, low, high = item[enough], doc[enough], (place[last] + q - self.reach[item])[enough], (place + self.reach[item])[enough]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (low[1:] > high[:-1])
            begins = np.flatnonzero(new)
            ends = np.append(begins, len(k))[1:] - 1
            at = first[d[begins]]
            yield from zip(d[begins].tolist(), k[begins].tolist(), np.maximum(0, low[begins] - at).tolist(), (high[ends] - at).tolist(), strict=True)
            a = b


class Index:
    """Embedded windows of benchmark items, and the search of texts for them."""

    def __init__(self, items: Sequence[tuple[int, str | None]]) -> None:
        split = [(number, words_of(text or "")) for number, text in items]
        split = [(number, words) for number, words in split if len(words) >= LEAST_WORDS]
        self.vocabulary: dict[str, int] = {}
        coded = [(number, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)) for number, words in split]
        rng, sizes, by_size = np.random.default_rng(SEED), window_sizes(), {}
        for number, item in coded:
            by_size.setdefault(max(s for s in sizes if s <= len(item)), []).append((number, item))
        self.classes = [LengthClass(s, [i for _, i in held], [n for n, _ in held], len(self.vocabulary), rng) for s, held in sorted(by_size.items())]

    def search(self, texts: Sequence[str | None]) -> list[list[dict]]:
        """For each text its items, nearest stretch and edits."""
        out: list[list[dict]] = [[] for _ in texts]
        chunk, count, get = [], 0, self.vocabulary.get
        for n, text in enumerate(texts):
            words = words_of(text or "")
            chunk.append((n, np.fromiter(map(get, words, repeat(0)), np.int32, len(words))))
            count += len(words)
            if count >= CHUNK_WORDS:
                self._search(chunk, texts, out)
                chunk, count = [], 0
        self._search(chunk, texts, out)
        return out

    def _search(self, chunk: list[tuple[int, np.ndarray]], texts: Sequence[str | None], out: list[list[dict]]) -> None:
        """Adds what the chunk's texts hold. Between texts lie so many unknown words that an item at an end fits a window of its class with all deletions it may have."""
        if not chunk or not self.classes:
            return
        pad = np.zeros(max((c.padding for c in self.classes if c.repeats), default=0), np.int32)
        ids = np.concatenate([x for _, i in chunk for x in (i, pad)])
        lengths = np.array([len(i) + len(pad) for _, i in chunk])
        first = np.cumsum(lengths) - lengths
        doc_of = np.repeat(np.arange(len(chunk)), lengths)
        for held in self.classes:
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for d, k, low, high in (held.walked if held.repeats else held.counted)(ids, doc_of, first):
                item = held.items[k]
                edits, a, b = nearest(item.tolist(), chunk[d][1][low:high].tolist())
                if edits <= allowed(len(item)) and (edits, low + a) < best.get((d, k), (1 << 30, 0, 0))[:2]:
                    best[d, k] = (edits, low + a, low + b)
            for (d, k), (edits, a, b) in best.items():
                n = chunk[d][0]
                marks = list(TOKEN.finditer(texts[n]))
                out[n].append({"item": held.numbers[k], "edits": edits, "item_words": len(held.items[k]), "start": marks[a].start(), "stop": marks[b - 1].end()})


def searcher(index: Index):
    """The index as a column function of texts."""
    bounded_batches()

    @F.pandas_udf(HITS)
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series(index.search(texts.tolist()), dtype=object)

    return search


def find_items(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text", text_col: str = "text", into: str = "hits") -> DataFrame:
    """docs with an array of the benchmark items that each holds, in the column `into` (an own column of that name is replaced).

    Items are named by their key, in its own type; items with a null key by null."""
    total = benchmark.select(F.sum(F.length(item_text))).first()[0] or 0
    parts = max(1, math.ceil(total / 5 / INDEX_WORDS))
    part = F.pmod(F.xxhash64(F.col(item_key), F.col(item_text)), F.lit(parts))
    kind = benchmark.schema[item_key].dataType

    def held(k: int) -> Column:
        rows = benchmark.filter(part == k).select(F.col(item_key).cast("string"), item_text).collect()
        index = Index(sorted(((r[0], r[1]) for r in rows if r[1] is not None), key=lambda x: (x[0] is None, x[0] or "", x[1])))
        named = lambda h: F.struct(h["item"].cast(kind).alias("item"), h["edits"].alias("edits"), h["item_words"].alias("item_words"), h["start"].alias("start"), h["stop"].alias("stop"))
        return F.transform(searcher(index)(F.col(text_col)), named)

    if parts == 1:
        return docs.withColumn(into, held(0))
    found: DataFrame | None = None
    for k in range(parts):
        texts = docs.select(F.sha2(F.col(text_col), 256).alias("text"), held(k).alias("hits")).filter(F.size("hits") > 0)
        one = cut(texts.groupBy("text").agg(F.first("hits").alias("hits")))
        found = one if found is None else found.unionAll(one)
    found = found.groupBy("text").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    (print_, hits) = own(docs, "_print", "_hits_of_print")
    joined = docs.withColumn(print_, F.sha2(F.col(text_col), 256)).join(found.withColumnsRenamed({"text": print_, "hits": hits}), print_, "left")
    return joined.withColumn(into, F.coalesce(hits, F.array().cast(found.schema["hits"].dataType))).drop(print_, hits)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns."""
    (into,) = own(docs, "_hits")
    return find_items(docs, benchmark, text_col=text_col, into=into).filter(F.size(into) == 0).drop(into)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("hit"))
    similarity = 1 - F.col("hit.edits") / F.col("hit.item_words")
    return hits.select("doc_id", F.col("hit.item").alias("item_id"), "hit.edits", "hit.item_words", similarity.alias("similarity"), "hit.start", "hit.stop")
