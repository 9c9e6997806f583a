"""Wikitext of any nesting to plain text, with the names of what was dropped or left open.

Templates are evaluated from the inside out by one scan with a stack, by a policy that the caller gives; markup goes by the
table of patterns below. An Arrow UDF, as nesting is beyond regular expressions."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------------------
# Markup (pattern, replacement, flag where it occurs), applied in this order, before and after the templates.
BLOCKS = ("gallery", "timeline", "math", "score")
BEFORE_TEMPLATES = (
    (r"\r\n?", "\n", None),
    (r"(?s)<!--.*?-->", "", None),
    (r"(?i)</?(?:includeonly|onlyinclude)\b[^>]*>", "", None),
    (r"(?is)<ref\b[^>]*/\s*>|<ref\b[^>]*>.*?</ref\s*>", "", None),
    (r"(?i)<references\b[^>]*/?\s*>", "", None),
    *((rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "", f"removed_{tag}_block") for tag in BLOCKS),
    (r"(?s)\{\|.*?\|\}", "", "removed_wikitable"),
)
AFTER_TEMPLATES = (
    (r"(?i)\[\[(?:File|Immagine|Category|Categoria):[^\]]+\]\]", "", None),
    (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", r"\1", None),
    (r"\[https?://\S+\s+([^\]]+)\]", r"\1", None),
    (r"\[https?://[^\]]+\]", "", None),
    (r"(?i)<section\b[^>]*/?\s*>", "", None),
    (r"(?i)<br\s*/?>", "\n", None),
    (r"(?i)</?(?:poem|div|span|p|center|small|big|sup|sub|i|b|em|strong|font|u|s|strike|blockquote|nowiki|ol|ul|li|dl|dt|dd)\b[^>]*>", "", None),
    (r"<[^>]+>", "", "unresolved_html_tag"),
    (r"(?m)^[^\S\n]*=+[^\S\n]*(.*?)[^\S\n]*=+[^\S\n]*$", r"\1", None),
    (r"'{2,3}", "", None),
)
WHITE = ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))
LEFT_OPEN = (("{{", "unresolved_template_markup"), ("}}", "unresolved_template_markup"), ("<pages", "unresolved_pages_transclusion"), ("�", "replacement_character"))
# -------------------------------------------------------------------------------------------------

PIECE = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|]+|.", re.S)


@dataclass(frozen=True)
class Templates:
    """What becomes of a template, by its lower-case name: nothing, its last plain argument, that with a flag, its first one
    (names that start so; of a file link the caption), the name itself. Any other is dropped and flagged."""

    discard: frozenset[str] = frozenset()
    keep: frozenset[str] = frozenset()
    gap: frozenset[str] = frozenset()
    initial: tuple[str, ...] = ()
    literal: frozenset[str] = frozenset({"§", "§§"})

    def value(self, parts: list[str], flags: set[str]) -> str:
        name = " ".join(parts[0].lower().replace("_", " ").split())
        plain = [p.strip() for p in parts[1:] if "=" not in p]
        if name in self.discard:
            return ""
        if self.initial and name.startswith(self.initial):
            caption = re.fullmatch(r"(?is)\[\[(?:File|Immagine):[^|]*(?:\|(.*))?\]\]", plain[0]) if plain else None
            return (caption[1] or "").rpartition("|")[2].strip() if caption else plain[0] if plain else ""
        if name in self.gap:
            flags.add("transcription_gap_template")
        if name in self.gap or name in self.keep:
            return plain[-1] if plain else ""
        if name in self.literal:
            return name
        flags.add(f"unresolved_template:{name or 'empty'}")
        return ""


def expand(text: str, policy: Templates, flags: set[str]) -> str:
    """The text with its templates evaluated; what isn't closed stays as it is."""
    frames: list[list[list[str]]] = [[[]]]  # of each open template its parts, each a list of pieces
    links = [0]  # links that are open in it: their bars don't part arguments
    for m in PIECE.finditer(text):
        piece, parts = m[0], frames[-1]
        if piece == "{{":
            frames.append([[]])
            links.append(0)
        elif piece == "}}" and len(frames) > 1:
            frames.pop()
            links.pop()
            frames[-1][-1].append(policy.value(["".join(p) for p in parts], flags))
        elif piece == "|" and len(frames) > 1 and not links[-1]:
            parts.append([])
        else:
            links[-1] += (piece == "[[") - (piece == "]]" and links[-1] > 0)
            parts[-1].append(piece)
    while len(frames) > 1:
        open_ = "{{" + "|".join("".join(p) for p in frames.pop())
        frames[-1][-1].append(open_)
    return "".join(frames[0][0])


def clean(text: str, policy: Templates, page: bool = False) -> tuple[str, list[str]]:
    """(plain text, sorted flags); page: what a page shows only by itself (noinclude) goes too."""
    flags: set[str] = set()

    def apply(value: str, steps) -> str:
        for pattern, by, flag in steps:
            value, n = re.subn(pattern, by, value)
            if n and flag:
                flags.add(flag)
        return value

    alone = ((r"(?is)<noinclude\b[^>]*>.*?</noinclude\s*>", "", None),) if page else ()
    value = apply(text or "", (*BEFORE_TEMPLATES[:2], *alone, *BEFORE_TEMPLATES[2:]))
    value = html.unescape(apply(expand(value, policy, flags), AFTER_TEMPLATES))
    for pattern, by in WHITE:
        value = re.sub(pattern, by, value)
    flags.update(flag for mark, flag in LEFT_OPEN if mark in value.lower())
    return value.strip(), sorted(flags)


def plain_text(text: Column, policy: Templates = Templates(), page: bool = False) -> Column:
    """A struct of the plain text and the flags of a wikitext column; null counts as empty."""

    @F.pandas_udf("text string, flags array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(t, policy, page) for t in texts], columns=["text", "flags"])

    return run(text)
