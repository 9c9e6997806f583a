"""Text expressions on columns. All are built-in Spark functions, so they stay in generated code.

Lines are cut at \\n; blank lines never count. Regular expressions carry (?U) where letters or white
space of all scripts are meant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.udfs import character_variety

# Fixed values ------------------------------------------------------------------------------------
CURLY_APOSTROPHE = "’"
SINGLE_LETTER_BRACKET = r"\[([A-Za-zÀ-ÖØ-öø-ÿ])\]"
NUMBER_LINE = r"^\s*\d{1,3}\s*$"
BRACKET_LINE = r"^\s*[\[\]]\s*$"
BRACKETED = r"\[([^\]\n]{1,160})\]"
EDITORIAL_LABEL = r"\[\s*(?:\d+(?:\s*[-–—,;]\s*\d+)*|[A-Z]{1,3}|[IVXLCDM]{1,6})\s*\]"
EDITORIAL_ELLIPSIS = r"\[[.·…\s–—-]+\]"
PAGE_MARKER = r"(?im)^\s*(?:pag(?:ina)?\.?|page)\s*\d+\s*$"
TERMINAL_MARKS = ".!?…"
CLOSING_MARKS = "'\"’”»)]}"
BOUNDARY_MARKER = "<|poem_end|>"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# -------------------------------------------------------------------------------------------------




def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(text: Column, pattern: str) -> Column:
    """Number of matches of a pattern, as a long."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_literal(text: Column, part: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def lines(text: Column) -> Column:
    """Pieces between line feeds; the empty piece behind a last line feed is left out."""
    pieces = F.split(text, "\n", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def filled_lines(text: Column) -> Column:
    """Lines that hold more than white space."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"(?U)\S")))


def non_empty_line_count(text: Column) -> Column:
    return F.size(filled_lines(text)).cast("long")


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_spaced(text: Column) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical_whitespace(text: Column) -> Column:
    """Line feeds only, runs of blanks as one, no blanks around line feeds, at most one blank line, no ends."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, "[\\t\\f\\x0B ]+", " ")
    out = F.regexp_replace(out, " *\\n *", "\n")
    return strip(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def normal_boundaries(text: Column) -> Column:
    """Line feeds only, no trailing blanks, at most one blank line, one final line feed."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n")
    return F.concat(strip(out), F.lit("\n"))


def clean_lines(text: Column) -> Column:
    """Poem lines: straight apostrophes, single bracketed letters freed, blank, number and lone bracket lines dropped."""
    out = F.regexp_replace(F.replace(text, F.lit(CURLY_APOSTROPHE), F.lit("'")), SINGLE_LETTER_BRACKET, "$1")
    kept = F.filter(F.transform(F.split(out, "\n", -1), one_spaced), lambda x: (x != "") & ~x.rlike(NUMBER_LINE) & ~x.rlike(BRACKET_LINE))
    return F.concat(strip(F.array_join(kept, "\n")), F.lit("\n"))


def clean_editorial_brackets(text: Column) -> Column:
    """Bracketed labels go, bracketed ellipses become three dots, other brackets are opened and their content trimmed."""
    out = F.regexp_replace(text, EDITORIAL_LABEL, "")
    out = F.regexp_replace(out, EDITORIAL_ELLIPSIS, "...")
    return F.regexp_replace(out, r"(?U)\[\s*([^\]\n]{1,160}?)\s*\]", "$1")


def clean_verse_lines(text: Column) -> Column:
    """Lines without verse numbers at their end, one-spaced."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: strip(F.regexp_replace(one_spaced(x), r"\s+\d{1,4}$", ""))), "\n")


def between_markers(text: Column, start: str, end: str) -> Column:
    """What lies between the line that begins with `start` and the line that begins with `end`, in either case; each may be missing."""
    rows = F.split(text, "\n", -1)
    marks = lambda x, what: F.regexp_like(x, F.lit(rf"(?iU)^\s*\Q{what}\E"))
    at = lambda what, none: F.coalesce(F.nullif(F.array_position(F.transform(rows, lambda x: marks(x, what)), True), F.lit(0)), none)
    first, last = at(start, F.lit(0)), at(end, F.size(rows) + 1)
    return F.when(last > first, F.array_join(F.slice(rows, first.cast("int") + 1, (last - first - 1).cast("int")), "\n")).otherwise(text)


def replace_first(text: Column, what: str, by: str) -> Column:
    """Only the first occurrence of a literal replaced."""
    at = F.instr(text, what)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + len(what), F.length(text)))).otherwise(text)


def cut_at_last(text: Column, marker: str) -> Column:
    """The text before the last occurrence of a marker."""
    return F.when(F.contains(text, F.lit(marker)), F.regexp_replace(text, f"(?s)^(.*)\\Q{marker}\\E.*$", "$1")).otherwise(text)


def clean_wikitext(text: Column) -> Column:
    """Flat wikitext: comments, references, links, templates of depth one, tags, quote marks, entities."""
    out = F.regexp_replace(text, "(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, "(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    out = F.regexp_replace(out, r"(?s)\{\|.*?\|\}", "")
    out = F.regexp_replace(out, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(F.regexp_replace(out, "(?i)<br\\s*/?>", "\n"), "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, "'{2,}", "")


# Normal forms ------------------------------------------------------------------------------------


def exact_form(text: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(one_spaced(text))


def memorization_form(text: Column) -> Column:
    """Lower-case words joined by single spaces, punctuation kept."""
    return F.lower(one_spaced(text))


def loose_words(text: Column) -> Column:
    """Lower-case letter runs without the accents of Latin-1; udfs.nfkd_words is the general form."""
    low = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN)
    return F.regexp_extract_all(low, F.lit(r"(?U)([^\W\d_]+)"))


def letter_words(text: Column) -> Column:
    """Lower-case letter runs, accents kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([^\W\d_]+)"))


def title_key(title: Column, particles: tuple[str, ...] = ("il", "lo", "la", "i", "gli", "le", "l", "un", "uno", "una")) -> Column:
    """Sorted distinct loose words of a title, articles left out."""
    return F.array_join(F.array_sort(F.filter(loose_words(title), lambda w: ~w.isin(*particles))), " ")


def slug(text: Column) -> Column:
    return F.array_join(loose_words(text), "-")


# Identities --------------------------------------------------------------------------------------


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def group_id(prefix: str, key: Column) -> Column:
    """prefix:first 16 hex digits of the key's SHA-256."""
    return F.concat(F.lit(prefix + ":"), F.substring(sha(key), 1, 16))


def words_hash(words: Column) -> Column:
    """SHA-256 over the words, each followed by a zero byte; no words: that of nothing."""
    return sha(F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("\0"))), ""))


# N-grams -----------------------------------------------------------------------------------------


def _runs(items: Column, n: int, glue: str) -> Column:
    """Every run of n items of an array, joined; none for shorter arrays."""

    def runs(held: Column) -> Column:
        count = F.size(held) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(held, i, n), glue))
        return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def word_grams(words: Column, n: int) -> Column:
    """Every run of n words, joined by spaces; none for shorter texts."""
    return _runs(words, n, " ")


def char_grams(text: Column, n: int) -> Column:
    """Every run of n characters; none for shorter texts."""
    if n <= 0:
        raise ValueError("n must be positive")
    return _runs(F.filter(F.split(text, ""), lambda c: c != ""), n, "")


def distinct_grams(grams: Column) -> Column:
    return F.array_distinct(grams)


def repeated_ratio(grams: Column) -> Column:
    """1 - distinct / all; no grams: 0."""
    return let(grams, lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0)))


def unique_character_ratio(text: Column) -> Column:
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(F.length(text) > 0, F.size(chars) / F.length(text)).otherwise(F.lit(0.0))


def containment(part: Column, whole: Column) -> Column:
    """Share of the part's distinct grams that the whole holds."""
    n = F.size(F.array_distinct(part))
    return F.when(n > 0, F.size(F.array_intersect(part, whole)) / n).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def shingle_sketch(grams: Column, size: int = 256) -> Column:
    """The smallest distinct 64-bit hashes of the grams."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))), 1, size)


def shingle_anchors(grams: Column, mask: int = 1023) -> Column:
    """Distinct hashes of the grams whose masked bits are zero."""
    return F.filter(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))), lambda h: h.bitwiseAND(F.lit(mask).cast("long")) == 0)


# Scores and shapes -------------------------------------------------------------------------------


def score_bundle(text: Column, prompt: Column, n: int = 4, marker: str = BOUNDARY_MARKER) -> Column:
    """Characters, lines, markers, character variety, repetition, prompt kept."""
    variety = character_variety(text, n)
    return F.struct(
        F.length(text).cast("long").alias("character_count"),
        non_empty_line_count(text).alias("non_empty_line_count"),
        count_literal(text, marker).alias("boundary_marker_count"),
        variety["unique"].alias("unique_character_ratio"),
        variety["repeated"].alias("repetition_ratio"),
        F.startswith(text, prompt).alias("prompt_preserved"),
    )


def ends_with_terminal(text: Column) -> Column:
    """Whether the text ends in a full stop, exclamation or question mark or ellipsis, closing marks aside."""
    return F.regexp_like(text, F.lit(r"(?U)[.!?…]['\"’”»)\]}]*\s*$(?!\n)"))


def longest_line(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(filled_lines(text), lambda x: F.length(x))), F.lit(0)).cast("long")


def stanza_pattern(text: Column) -> Column:
    """Filled lines in each block between blank lines."""
    blocks = F.split(F.concat(F.lit("\n"), text), r"(?U)\n[^\S\n]*(?=\n)", -1)
    return F.filter(F.transform(blocks, lambda b: F.size(filled_lines(b))), lambda n: n > 0)


def rhyme_keys(text: Column, width: int = 3) -> Column:
    """The last letters of each filled line's last loose word."""
    last = lambda line: F.try_element_at(loose_words(line), F.lit(-1))
    return F.transform(filled_lines(text), lambda x: F.right(last(x), F.lit(width)))


def rhyme_signature(keys: Column) -> Column:
    """A letter for each key, by first appearance."""
    letters = lambda order: F.transform(keys, lambda k: F.char((F.array_position(order, k) + 64).cast("long")))
    return F.array_join(let(F.array_distinct(keys), letters), "")


def rhyme_evidence(keys: Column) -> Column:
    """Fourteen lines whose first eight and last six repeat their endings enough."""

    def repeats(part: Column) -> tuple[Column, Column]:
        counts = let(part, lambda p: F.transform(F.array_distinct(p), lambda k: F.size(F.filter(p, lambda x: x == k))))
        many = F.filter(counts, lambda n: n >= 2)
        return F.aggregate(many, F.lit(0), lambda a, x: a + x), F.size(many)

    (octave, octave_kinds), (sestet, sestet_kinds) = repeats(F.slice(keys, 1, 8)), repeats(F.slice(keys, 9, 6))
    full = (F.size(keys) == 14) & ~F.exists(keys, lambda k: k.isNull())
    return F.coalesce(full & (octave >= 6) & (octave_kinds >= 2) & (sestet >= 4) & (sestet_kinds >= 1), F.lit(False))


def reverse_words_after_first(text: Column) -> Column:
    """A control text: the words of every line but the first in reverse order."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(i == 0, x).otherwise(F.array_join(F.reverse(F.split(x, " ")), " "))), "\n")


def first_line(text: Column) -> Column:
    return F.try_element_at(filled_lines(text), F.lit(1))


def remainder(text: Column, n: int = 13) -> Column:
    return F.array_join(F.slice(filled_lines(text), 2, n), "\n")


# URLs, tables, markup ----------------------------------------------------------------------------


def url_key(url: Column) -> Column:
    """Host without www and the path without its last slash, lower case."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^www\\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(host, F.lower(path))


def title_from_url(url: Column) -> Column:
    """The last path segment, decoded, underscores as spaces."""
    segment = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "([^/]*)/?$", 1)
    return F.replace(F.try_url_decode(segment), F.lit("_"), F.lit(" "))


def encode_metrics(key: Column, values: dict[str, Column]) -> Column:
    """key|name=value;name=value"""
    return F.concat(key, F.lit("|"), F.concat_ws(";", *[F.concat(F.lit(k + "="), v.cast("string")) for k, v in values.items()]))


def decode_metrics(cell: Column) -> Column:
    """A map of the metrics behind the first bar."""
    return F.str_to_map(F.substring_index(cell, "|", -1), F.lit(";"), F.lit("="))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def compact_sample(text: Column, n: int = 120) -> Column:
    flat = one_spaced(text)
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n - 3)), F.lit("..."))).otherwise(flat)
