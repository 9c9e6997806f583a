"""Arrow UDFs for what Spark has no expression for: Unicode normal forms, substring and sequence likeness."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")


def nfkd(text: str) -> list[str]:
    """Letter runs of the case-folded text without combining marks."""
    flat = unicodedata.normalize("NFKD", (text or "").casefold())
    return LETTERS.findall("".join(c for c in flat if not unicodedata.combining(c)))


def positioned(text: str) -> list[dict]:
    """Letter runs in normal form with their bounds in the original text."""
    out = []
    for m in LETTERS.finditer(text or ""):
        word = "".join(nfkd(m[0]))
        if word:
            out.append({"word": word, "start": m.start(), "stop": m.end()})
    return out


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, by a suffix automaton of the shorter text: linear in both."""
    if len(a) > len(b):
        a, b = b, a
    links, lengths, edges, last = [-1], [0], [{}], 0
    for c in a:
        cur = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = links[p]
        if p >= 0:
            q = edges[p][c]
            if lengths[q] == lengths[p] + 1:
                links[cur] = q
            else:
                clone = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    state = length = best = 0
    for c in b:
        while state and c not in edges[state]:
            state = links[state]
            length = lengths[state]
        if c in edges[state]:
            state, length = edges[state][c], length + 1
        best = max(best, length)
    return best


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def variety(text: str | None, n: int) -> tuple[float, float]:
    """(distinct characters by all, 1 - distinct runs of n characters by all); 0 where there are none."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return 0.0, 0.0
    letters, ids = np.unique(codes, return_inverse=True)
    runs, bound = ids, len(letters)
    for width in range(1, min(n, len(codes))):  # a run one longer is the run so far and the next character
        if bound * len(letters) >= 1 << 62:
            kinds, runs = np.unique(runs, return_inverse=True)
            bound = len(kinds)
        runs = runs[:-1] * len(letters) + ids[width:]
        bound *= len(letters)
    found = len(codes) - n + 1
    return len(letters) / len(codes), 1 - len(np.unique(runs)) / found if found > 0 else 0.0


def character_variety(text: Column, n: int) -> Column:
    """(unique, repeated): the share of distinct characters, and that of repeated runs of n characters."""
    if n <= 0:
        raise ValueError("n must be positive")

    @F.pandas_udf("unique double, repeated double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([variety(t, n) for t in texts], columns=["unique", "repeated"])

    return measure(text)


def _column(fn, kind: str):
    """A column function that gives the values of one row to fn."""

    def apply(*cols: Column) -> Column:
        if len(cols) == 1:

            @F.pandas_udf(kind)
            def one(x: pd.Series) -> pd.Series:
                return pd.Series([fn(v) for v in x], dtype=object if kind.startswith("array") or kind == "string" else None)

            return one(*cols)

        @F.pandas_udf(kind)
        def two(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([fn(v, w) for v, w in zip(x, y, strict=True)])

        return two(*cols)

    return apply


nfkd_words = _column(nfkd, "array<string>")
positioned_words = _column(positioned, "array<struct<word:string,start:int,stop:int>>")
longest_common_substring = _column(lambda a, b: longest_common(a or "", b or ""), "int")
sequence_ratio = _column(ratio, "double")
word_sequence_ratio = _column(lambda a, b: SequenceMatcher(None, (a or "").split(), (b or "").split(), autojunk=False).ratio(), "double")
nfkc_alphanumerics = _column(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum()), "string")
