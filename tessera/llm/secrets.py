"""Secret scan by corpus-wide ownership frequency (operator 5).

Each whole text is scanned for candidates: the three base kinds, and free-standing random-looking
strings (kind `token`). Only a digest of a candidate's value leaves the text. Over the corpus the
digests are counted by distinct repositories and owners, with one row for each (digest, owner,
repository) before any digest comes together, so a value that a third of the corpus quotes is summed
up from partial counts. A value that more than `MAX_OWNERS` owners share in more than `MAX_REPOS` repositories is a copied
example; one that few owners hold, or that lies in few repositories (a page and its mirror), looks live. Base spans are always reported, with that verdict; `token` spans only
when they look live.

Defined cases: a null text counts as empty; null repositories and owners count as one of their own;
repeated rows are counted once in the frequencies and reported each; an empty table gives an empty
result; other columns are not read. Every pattern runs in time proportional to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut, per_text, table

KINDS = ("assign", "access", "hex", "token")
#: The base patterns. Letters of the key words count in either case, so each is spelled out; \x27 is an apostrophe.
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
DIGIT = re.compile("[0-9]")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Bits a character that a random-looking token has at least.
MIN_BITS = 3.5
#: A value with at most so many owners, or in at most so many repositories, looks live.
MAX_OWNERS, MAX_REPOS = 2, 3

FOUND = "found array<struct<kind:string,start:int,stop:int,digest:string>>"


def bits(value: str) -> float:
    """Entropy of the value's characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds, by start, then by kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def token_spans(text: str, taken: list) -> list[tuple[str, int, int, str]]:
    """Free-standing random-looking strings outside the taken spans."""
    if not DIGIT.search(text):
        return []
    out, at = [], 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][2] <= m.start():
            at += 1
        if any(t[1] < m.end() and m.start() < t[2] for t in taken[at : at + 3]):
            continue
        value = m[0]
        digits = sum(map(str.isdigit, value))
        if 3 <= digits <= len(value) - 3 and bits(value) >= MIN_BITS:
            out.append(("token", m.start(), m.end(), value))
    return out


def candidates(text: str) -> tuple[list]:
    """Every candidate of a text, with a digest in place of its value."""
    base = base_spans(text)
    found = sorted(base + token_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))
    return ([{"kind": k, "start": a, "stop": b, "digest": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for k, a, b, v in found],)


def scan(docs: DataFrame, key: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(key, spans): one row for each row of docs; spans hold kind, start, stop, digest, repos, owners and live."""
    read = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(repo_col).cast("string").alias("_repo"), F.col(owner_col).cast("string").alias("_owner"), per_text(candidates, FOUND)(F.col(text_col))["found"].alias("_found")
    )
    read = cut(read)
    each = read.filter(F.size("_found") > 0).select("_row", "_repo", "_owner", F.explode("_found").alias("_s"))
    held = each.select(F.col("_s.digest").alias("_digest"), "_owner", "_repo").distinct()
    by_owner = held.groupBy("_digest", "_owner").agg(F.count("*").alias("_repos"))
    spread = by_owner.groupBy("_digest").agg(F.sum("_repos").alias("_repos"), F.count("*").alias("_owners"))
    judged = each.join(spread, F.col("_s.digest") == F.col("_digest"))
    live = (F.col("_owners") <= max_owners) | (F.col("_repos") <= max_repos)
    span = F.struct("_s.start", "_s.stop", "_s.kind", "_s.digest", F.col("_repos").alias("repos"), F.col("_owners").alias("owners"), live.alias("live"))
    judged = judged.filter(live | (F.col("_s.kind") != "token")).groupBy("_row").agg(F.collect_list(span).alias("_spans"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    rank = lambda s: s["start"].cast("long") * len(KINDS) + order[s["kind"]]
    ordered = F.array_sort("_spans", lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0))
    out = read.join(judged, "_row", "left")
    return out.select(F.col("_key").alias(key), F.coalesce(ordered, F.array().cast(judged.schema["_spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, with how many of them look live or widely copied."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = scan(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select(
        "doc_id",
        *[of(k) for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
