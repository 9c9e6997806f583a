"""Personal data by a skip-chain conditional random field (operator 3).

The base patterns give spans of four kinds; those are always reported. A conditional random field
then labels the tokens that can be part of such an entity at all, those with a digit or an at sign;
plain words are fixed to "none", so chains break at them and that is exact. Neighbouring tokens
share a transition potential, and distant tokens that repeat or resemble each other (the same last digits, or the
same mailbox) share a skip potential with the first of them, so any two mentions are two steps apart however far the text.
Loopy sum-product message passing spreads what one mention shows to the others in the document. Tokens that come out as part
of an entity and that no base span covers give further spans, of the same four kinds: a number repeated without its
prefix, an address or a card in another layout, a phone that runs into the number behind it.

The weights are learnt here, by pseudo-likelihood, from the base spans of a bounded sample of documents
(`TRAIN_DOCS`, by hash of the id) and their tokens (`TRAIN_TOKENS`). There are no labels for what the base patterns
miss, so training rehearses it: an entity is mentioned once more at the end of its text in a layout that no base
pattern takes (labelled as the entity), beside strangers of the same layout (labelled as none); tokens that resemble an entity
and aren't covered are left out, as their label isn't known; and a share of the
entities has its own features hidden as a whole, so that the potentials have to carry what the other mentions know.

Defined cases: a null text counts as empty; empty texts have no spans; repeated rows give the same
spans each; an empty table gives an empty result (and untrained weights, which add nothing); other
columns pass through. Each pattern and the message passing run in time proportional to the text:
repeated tokens are linked each to the first, never all to all.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import per_text, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What follows an at sign in an address; the rest of the base patterns, written so that each attempt is linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CLUE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
HEX = re.compile(r"[0-9a-f]{16,}")
CUES = {
    "mail": "email", "email": "email", "e-mail": "email", "contact": "email",
    "ip": "ip", "host": "ip", "address": "ip", "server": "ip",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card",
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
}

TRAIN_DOCS = 20_000
TRAIN_TOKENS = 50_000
HIDDEN_SHARE = 0.3
L2 = 1e-4
#: Bound on the rounds of message passing; it ends when no message changes any more.
ROUNDS = 60
#: Least probability of an added entity.
SURE = 0.9
SEED = 11
N_FEATURES = 31


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # no later address can reach back over this at sign
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not CLUE.search(text):
        return []
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs with a digit or an at sign, without the punctuation around them."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] in ".,;:!?)]}>\"'":
            b -= 1
        while a < b and text[a] in "([{<\"'":
            a += 1
        if a < b:
            out.append((a, b))
    return out


def features(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0/1 features for each token, and whether a token directly follows the one before it."""
    n = len(spans)
    x = np.zeros((n, N_FEATURES))
    near = np.zeros(n, bool)
    for i, (a, b) in enumerate(spans):
        t = text[a:b]
        d = only_digits(t)
        parts = t.split(".")
        quad = len(parts) == 4 and all(p and p.isascii() and p.isdigit() for p in parts)
        letters = any(c.isalpha() for c in t)
        f = [0]
        if "@" in t:
            f.append(1)
            if "." in t[t.index("@") :]:
                f.append(2)
        if len(d) == len(t):
            f.append(3)
        f.append(4 + int(np.searchsorted((1, 4, 7, 9, 13, 20), len(d), "right")))  # 4 to 10
        if quad:
            f.append(11)
            if all(octet(p) for p in parts):
                f.append(12)
        if t[0] == "+":
            f.append(13)
        if text[a - 1 : a] == "(" and text[b : b + 1] == ")":
            f.append(14)
        if "-" in t:
            f.append(15)
        if letters:
            f.append(16)
        if ":" in t or "=" in t:
            f.append(17)
        if 13 <= len(d) <= 19 and luhn(d):
            f.append(18)
        if len(t) > 30:
            f.append(19)
        if HEX.search(t):
            f.append(20)
        if len(d) >= len(t) - 2:
            f.append(21)
        if i and text[spans[i - 1][1] : a].strip(" ()-") == "" and a - spans[i - 1][1] <= 3:
            near[i] = True
            f.append(22)
        before = re.split(r"[^\w-]+", text[max(0, a - 24) : a].lower())
        for w in before[-3:]:
            if w in CUES:
                f.append(23 + KINDS.index(CUES[w]))  # 23 to 26
        x[i, f] = 1
    x[:-1, 27] = near[1:]
    if n:
        x[1:, 28] = near[1:] & (x[:-1, 13] > 0)
        x[1:, 29] = near[1:] & (x[:-1, 14] > 0)
        x[:-1, 30] = near[1:] & (x[1:, 14] > 0)
    return x, near


def likeness(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Skip edges: each token to the first one like it."""
    first: dict = {}
    edges = []
    for i, (a, b) in enumerate(spans):
        t = text[a:b]
        d = only_digits(t)
        if "@" in t:
            box, _, host = t.lower().partition("@")
            key = f"{box}@{host.split('.')[0]}"
        elif len(d) >= 7:
            key = d[-7:]
        elif len(d) >= 5:
            key = d
        else:
            continue
        if first.setdefault(key, i) != i:
            edges.append((first[key], i))
    return edges


def gold(spans: list[tuple[int, int]], entities: list[tuple[str, int, int]]) -> np.ndarray:
    """The label of each token by the entity that covers it, the last of several; both lists go by start, in one pass."""
    y, open_, at = np.zeros(len(spans), np.int64), [], 0
    for i, (c, d) in enumerate(spans):
        while at < len(entities) and entities[at][1] < d:
            open_.append(entities[at])
            at += 1
        open_ = [e for e in open_ if e[2] > c]  # at most a few: entities of one kind don't overlap
        if open_:
            y[i] = LABELS.index(open_[-1][0])
    return y


#: Entities of a text that training looks at, and mentions every second of once more: the others have to stand for themselves.
REHEARSED = 8


def relaid(kind: str, mention: str) -> str:
    """The same entity in a layout that no base pattern takes."""
    if kind == "email":
        box, _, host = mention.partition("@")
        return f"{box}@{host.split('.')[0]}"
    if kind == "ip":
        return mention.replace(".", "-")
    d = only_digits(mention)
    if kind == "card":
        return ".".join(d[i : i + 4] for i in range(0, len(d), 4))
    local = re.sub(r"^\+[0-9]{1,3}(?=[^0-9])[\x20.-]*", "", mention)
    return local if 7 <= len(only_digits(local)) < len(d) else d[-10:]


def stranger(mention: str) -> str:
    """Another number or box of the same layout."""
    return "".join(str((int(c) * 7 + 3 + i) % 10) if "0" <= c <= "9" else chr(97 + (ord(c) + 5 + i) % 26) if "a" <= c <= "z" else c for i, c in enumerate(mention))


def rehearsed(text: str, base: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with further mentions of some entities, and strangers like them, at its end; and all entities by start."""
    entities, parts, end = sorted(base, key=lambda s: s[1]), [text], len(text)
    for kind, a, b in entities[:REHEARSED]:
        again = relaid(kind, text[a:b])
        if zlib.crc32(text[a:b].encode()) % 2:
            entities = [*entities, (kind, end + 7, end + 7 + len(again))]
            other = stranger(again)
            added = f" again {again} and not {other} or {stranger(other)} or {stranger(stranger(other))} here"
            parts.append(added)
            end += len(added)
    return "".join(parts), entities


def learn_rows(text: str) -> tuple[list]:
    """For training: of each token its features as bits, its label, its chain neighbours' labels, the skip neighbours' label counts and its entity's number."""
    if not CLUE.search(text):
        return ([],)
    text, entities = rehearsed(text, base_spans(text))
    spans = tokens(text)
    x, near = features(text, spans)
    y = gold(spans, entities)
    left = np.where(near, np.concatenate(([0], y[:-1])), -1)
    right = np.where(np.concatenate((near[1:], [False])), np.concatenate((y[1:], [0])), -1)
    skips, like = np.zeros((len(spans), len(LABELS)), np.int64), likeness(text, spans)
    # What is like an entity but isn't covered may be one: its label isn't known, nor that of what it is chained to.
    whole = {a for a, b in like if y[a] or y[b]}
    chain = np.cumsum(~near)
    unsure = {int(chain[i]) for a, b in like if a in whole for i in (a, b) if not y[i]}
    known = np.array([bool(k) or int(c) not in unsure for k, c in zip(y, chain, strict=True)], bool)
    for a, b in like:
        skips[a, y[b]] += known[b]
        skips[b, y[a]] += known[a]
    bits = x.astype(np.int64) @ (1 << np.arange(N_FEATURES, dtype=np.int64))
    # Chained tokens of one label are one entity; its number draws whether it is hidden.
    entity = np.cumsum(~near | (np.concatenate(([-1], y[:-1])) != y)) + zlib.crc32(text.encode("utf-8", "surrogatepass")) if len(spans) else y
    return ([[int(b), int(k), int(p), int(q), *map(int, s), int(e)] for b, k, p, q, s, e, sure in zip(bits, y, left, right, skips, entity, known, strict=True) if sure],)


class Field:
    """Weights: of features (by label), of chain neighbours (label, next label) and of skip edges (label, label)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def learn(cls, rows: np.ndarray, steps: int = 600) -> Field:
        """Pseudo-likelihood with weight decay, by Adam; rows as learn_rows gives them."""
        k = len(LABELS)
        if not len(rows):
            zero = np.zeros((k, k))
            return cls(np.zeros((N_FEATURES, k)), zero, zero)
        x = ((rows[:, :1] >> np.arange(N_FEATURES)) & 1).astype(float)
        number = rows[:, -1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hidden = (number >> np.uint64(40)).astype(float) / (1 << 24) < HIDDEN_SHARE
        x[hidden, 1:] = 0
        y = rows[:, 1]
        left, right = (np.eye(k + 1)[rows[:, c] + 1][:, 1:] for c in (2, 3))
        skips = np.minimum(rows[:, 4:-1].astype(float), 2)
        w = np.zeros((N_FEATURES + 3 * k, k))
        # Each token thrice: with all its neighbours' labels, with those of its like only, and with its own features alone,
        # so that none of the three hides behind another.
        alone, none = ((rows[:, :1] >> np.arange(N_FEATURES)) & 1).astype(float), np.zeros((len(rows), k))
        data = np.vstack([np.hstack([x, left, right, skips]), np.hstack([x, none, none, skips]), np.hstack([alone, none, none, none])])
        target = np.eye(k)[np.concatenate((y, y, y))]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = data @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = data.T @ (p - target) / len(data) + L2 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        n = N_FEATURES
        chain = (w[n : n + k] + w[n + k : n + 2 * k].T) / 2
        skip = (w[n + 2 * k :] + w[n + 2 * k :].T) / 2
        return cls(w[:n], chain, skip)

    def marginals(self, x: np.ndarray, near: np.ndarray, skips: list[tuple[int, int]]) -> np.ndarray:
        """Each token's label probabilities, by damped loopy sum-product."""
        score = x @ self.unary
        edges = [(i - 1, i, self.chain) for i in np.flatnonzero(near)] + [(a, b, self.skip) for a, b in skips]
        if not edges:
            return softmax(score)
        a = np.array([e[0] for e in edges])
        b = np.array([e[1] for e in edges])
        pot = np.stack([e[2] for e in edges])
        src, dst = np.concatenate((a, b)), np.concatenate((b, a))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        pot = np.concatenate((pot, pot.transpose(0, 2, 1)))
        msg = np.zeros((len(src), score.shape[1]))
        for _ in range(ROUNDS):
            total = score.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            z = out[:, :, None] + pot
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            if np.abs(new - msg).max() < 1e-4:
                msg = new
                break
            msg = 0.5 * msg + 0.5 * new
        total = score.copy()
        np.add.at(total, dst, msg)
        return softmax(total)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans beside the base ones: runs of tokens that surely belong to one entity of a plausible form."""
        spans = tokens(text) if CLUE.search(text) else []
        if not spans or not self.unary.any():
            return []
        x, near = features(text, spans)
        p = self.marginals(x, near, likeness(text, spans))
        label = np.where(p.max(1) >= SURE, p.argmax(1), 0)
        taken = sorted((a, b) for _, a, b in base)
        out, at, i = [], 0, 0
        while i < len(spans):
            j = i + 1
            while j < len(spans) and near[j] and label[j] == label[i]:
                j += 1
            a, b = spans[i][0], spans[j - 1][1]
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            free = all(d <= a or b <= c for c, d in taken[at : at + 8])
            if label[i] and free and plausible(LABELS[label[i]], text[a:b]):
                out.append((LABELS[label[i]], a, b))
            i = j
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def plausible(kind: str, text: str) -> bool:
    """Whether an added span has the form of its kind."""
    n = len(only_digits(text))
    if kind == "email":
        return "@" in text[1:-1]
    if kind == "ip":
        parts = re.split("[.-]", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and octet(p) for p in parts)
    return 13 <= n <= 19 if kind == "card" else 7 <= n <= 15


def train(docs: DataFrame, key: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_tokens: int = TRAIN_TOKENS) -> Field:
    """The field's weights from a bounded sample of docs, chosen by hash of the key."""
    ids = docs.select(F.col(key).alias("_id")).orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(max_docs).distinct()
    some = docs.join(ids, docs[key].eqNullSafe(ids["_id"]), "left_semi").select(F.col(key).alias("_id"), per_text(learn_rows, "rows array<array<long>>")(F.col(text_col))["rows"].alias("rows"))
    each = some.select("_id", F.posexplode("rows").alias("_at", "row")).orderBy(F.xxhash64(F.lit(SEED), "_id", "_at"), "_id", "_at", "row").limit(max_tokens)
    rows = each.select("row").collect()
    return Field.learn(np.array([r["row"] for r in rows], np.int64).reshape(len(rows), 5 + len(LABELS)))


RESULT = "base array<struct<kind:string,start:int,stop:int>>, added array<struct<kind:string,start:int,stop:int>>"


def find_personal_data(docs: DataFrame, field: Field, text_col: str = "text", into: str = "personal") -> DataFrame:
    """docs with a struct of base and added spans in the column `into` (an own column of that name is replaced)."""

    def find(text: str) -> tuple:
        base = base_spans(text)
        shown = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in spans]
        return shown(base), shown(field.added(text, base))

    return docs.withColumn(into, per_text(find, RESULT)(F.col(text_col)))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train(docs)).select("doc_id", "personal.*")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    rank = lambda s: F.struct(order[s["kind"]], s["start"], s["stop"])
    ordered = lambda spans: F.array_sort(spans, lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of(k) for k in KINDS],
        F.sha2(listed(ordered(F.col("base"))), 256).alias("base_sha256"),
        listed(ordered(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
