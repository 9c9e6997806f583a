"""Literal cases of text, date and number expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.functions import udfs
from tessera.operators import rules, split


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


POEM = "\n".join(f"riga numero {w}" for w in "amore smarrita vita core amore smarrita vita core cielo mare luce velo mare conduce".split())


@pytest.mark.parametrize(
    "build, text, want",
    [
        (T.non_empty_line_count, "Amor\n\nche move\n", 2),
        (T.unique_character_ratio, "aabb", 0.5),
        (T.unique_character_ratio, "", 0.0),
        (lambda t: T.repeated_ratio(T.char_grams(t, 2)), "aaaaaa", 0.8),
        (lambda t: T.repeated_ratio(T.char_grams(t, 4)), "abc", 0.0),
        (T.memorization_form, " Amor\n  CHE\tmove ", "amor che move"),
        (lambda t: F.array_sort(T.distinct_grams(T.char_grams(t, 3))), "ababa", ["aba", "bab"]),
        (lambda t: T.containment(T.char_grams(t, 3), T.char_grams(F.lit("xxabcxy"), 3)), "abcdef", 0.25),
        (T.clean_lines, "prima ben[e]\n4\n  seconda   riga \n8\n]\n\nterza", "prima bene\nseconda riga\nterza\n"),
        (T.clean_lines, "prima riga\n[\n]\nseconda [Antéo] riga\n", "prima riga\nseconda [Antéo] riga\n"),
        (T.clean_editorial_brackets, "[1-3] vid[i] il testo [...] secondo [F] testimone.", " vidi il testo ... secondo  testimone."),
        (T.canonical_whitespace, " a \t b\r\n\r\n\r\n\r\nc \n d ", "a b\n\nc\nd"),
        (T.normal_boundaries, "a  \r\nb\n\n\n\nc", "a\nb\n\nc\n"),
        (T.loose_words, "L'Amor già È vivo.", ["l", "amor", "gia", "e", "vivo"]),
        (udfs.nfkd_words, "L'Amor già È vivo. Straße ﬁne", ["l", "amor", "gia", "e", "vivo", "strasse", "fine"]),
        (lambda t: T.rhyme_evidence(T.rhyme_keys(t)), POEM, True),
        (lambda t: F.size(T.word_grams(F.split(t, " "), 3)), "a b", 0),
        (T.stanza_pattern, "a\nb\n\nc\n \nd\ne\nf\n", [2, 1, 3]),
        (T.ends_with_terminal, "fine.»\n", True),
        (T.ends_with_terminal, "fine,", False),
        (T.reverse_words_after_first, "a b\nc d e", "a b\ne d c"),
        (T.url_key, "https://www.Example.com/A/b/?q=1", "example.com/a/b"),
        (T.title_from_url, "http://x.org/wiki/La_vita%20nova/", "La vita nova"),
        (lambda t: T.between_markers(t, "*** START", "*** END"), "x\n*** START of\na\nb\n*** END of\ny", "a\nb"),
        (lambda t: T.replace_first(t, "b", "X"), "abab", "aXab"),
        (lambda t: T.cut_at_last(t, "##"), "a##b##c", "a##b"),
        (T.clean_wikitext, "[[A|b]] {{x}}''c''<ref>d</ref> <!-- e -->&amp;<br/>f", "b c &\nf"),
        (T.markdown_cell, "a|b\nc", "a\\|b c"),
        (lambda t: T.words_hash(F.array().cast("array<string>")), "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
        (lambda t: T.count_literal(t, "aa"), "aaaaa", 2),
        (lambda t: udfs.longest_common_substring(T.memorization_form(t), F.lit("xx prima seconda yy")), "Prima\nSeconda", 13),
        (lambda t: D.roman(t), "MCMXCIV", 1994),
        (lambda t: D.roman(t), "IIX", None),
        (D.years, "nel 1321 e 12345 e 1999.", [1321, 1999]),
        (D.standalone_year, "(1845).", 1845),
        (D.standalone_year, "anno 1845", None),
        (lambda t: D.period_bucket(F.array(F.lit(1321), F.lit(1850))), "", "nineteenth_century_bridge"),
        (lambda t: D.period_bucket(F.array(F.lit(1321), F.lit(None).cast("int"))), "", "unknown"),
        (lambda t: D.duration(F.lit(3_725.4)), "", "1:02:05"),
        (lambda t: D.byte_size(F.lit(3 << 20)), "", "3.0 MiB"),
        (lambda t: N.half_even(F.lit(2.5), 0), "", 2.0),
        (lambda t: N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), "", None),
        (lambda t: rules.risk_band(F.lit(0.01), F.lit(160)), "", "high"),
        (lambda t: rules.risk_band(F.lit(0.15), F.lit(10)), "", "medium"),
        (lambda t: rules.risk_band(F.lit(0.01), F.lit(10)), "", "low"),
        (lambda t: split.percent_split("1337", t), "poem", "train"),
    ],
)
def test_expression(spark, build, text, want):
    assert value(spark, build(F.lit(text))) == want


def test_score_bundle(spark):
    got = value(spark, T.score_bundle(F.lit("Amor\nche move\n<|poem_end|>\n"), F.lit("Amor")))
    assert (got["character_count"], got["non_empty_line_count"], got["boundary_marker_count"], got["prompt_preserved"]) == (27, 3, 1, True)


def test_gram_size_zero():
    with pytest.raises(ValueError):
        T.char_grams(F, 0)


def test_rhyme_signature(spark):
    keys = F.array(*[F.lit(k) for k in ("ore", "ita", "ita", "ore", "elo")])
    assert value(spark, T.rhyme_signature(keys)) == "ABBAC"


def test_metric_cells(spark):
    cell = T.encode_metrics(F.lit("id"), {"a": F.lit(1), "b": F.lit("x")})
    assert value(spark, cell) == "id|a=1;b=x"
    assert value(spark, T.decode_metrics(cell)) == {"a": "1", "b": "x"}


def test_half_and_even_indices():
    assert split.even_indices(1, 5) == [0] and split.even_indices(3, 5) == [0, 2, 4]
    with pytest.raises(ValueError):
        split.even_indices(4, 3)


def test_sequence_likeness():
    assert udfs.longest_common("", "abc") == 0 and udfs.longest_common("xabcy", "zabcw") == 3
    assert udfs.ratio("abcd", "bcde") == 0.75


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("ab\n\U0001f600", max_size=80), st.integers(1, 12))
def test_character_variety(text, n):
    grams = [text[i : i + n] for i in range(len(text) - n + 1)]
    want = (len(set(text)) / len(text) if text else 0.0, 1 - len(set(grams)) / len(grams) if grams else 0.0)
    assert udfs.variety(text, n) == pytest.approx(want)
