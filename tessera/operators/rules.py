"""Rules: violations and flags as arrays, ordered decision tables, screens, gates and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values ------------------------------------------------------------------------------------
FUNCTION_WORDS = {
    "it": ("a", "che", "con", "da", "del", "della", "di", "e", "gli", "il", "in", "la", "le", "lo", "ma", "nel", "non", "per", "si", "un", "una"),
    "en": ("a", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"),
    "de": ("als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"),
    "fr": ("au", "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "ou", "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
    "es": ("con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"),
}
META_TEXT = {
    "numbered_verse_label": r"(?imU)^\s*(?:primo|secondo|terzo|quarto|quinto|sesto|settimo|ottavo|nono|decimo|undicesimo|dodicesimo|tredicesimo|quattordicesimo)\s+verso\s*:",
    "generic_sonnet_label": r"(?imU)^\s*sonetto(?:\s+classico)?(?:\s+in\s+italiano)?\s*[.:]?\s*$",
    "sonnet_explanation": r"(?imU)^\s*(?:in\s+questo\s+sonetto|il\s+sonetto\s+(?:proposto|presentato|è|si\s+compone|si\s+descrive)|questo\s+sonetto)\b",
    "commentary_label": r"(?imU)^\s*(?:spiegazione|commento|analisi|nota)\s*:",
}
SUSPICIOUS = {
    "wiki_template": r"\{\{|\}\}",
    "wiki_link": r"\[\[|\]\]",
    "html_or_reference": r"(?i)</?(?:ref|div|span|br|p)\b",
    "web_address": r"(?i)https?://|www\.",
    "replacement_character": "�",
}
LONG_LINE, HIGH_REPETITION, POEM_LINES = 120, 0.35, 14
# -------------------------------------------------------------------------------------------------


def flags(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold, in their order. A rule that is null doesn't hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def decide(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The first rule that holds decides."""
    out = None
    for rule, outcome in rules:
        out = F.when(rule, outcome) if out is None else out.when(rule, outcome)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Fails if a column is missing or there are no rows."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("no rows")


def validate(df: DataFrame, rules: Mapping[str, Column], into: str = "violations") -> DataFrame:
    """df with the names of the violated rules; each rule says what is wrong."""
    return df.withColumn(into, flags(rules))


def assert_valid(df: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """df as it is; reading a row that violates a rule fails with its key and the first rule."""
    wrong = flags(rules)
    message = F.concat(F.lit("row "), F.col(key).cast("string"), F.lit(": "), F.try_element_at(wrong, F.lit(1)))
    return df.filter(F.coalesce(F.assert_true(F.size(wrong) == 0, message).isNull(), F.lit(True)))


def manifest_filter(df: DataFrame, dataset: str, split: str) -> DataFrame:
    """Rows of a string manifest that belong to a data set's split and have a text path."""
    return df.filter((F.col(f"include_in_{dataset}") == "True") & (F.col(f"split_{dataset}") == split) & (F.coalesce(F.col("clean_text_path"), F.lit("")) != ""))


def active_units(df: DataFrame, view: str = "training") -> DataFrame:
    """Units by eligibility: training (the default hides protected ones), protected, or all."""
    active = df.filter(F.col("activation_status") == "active")
    if view == "all":
        return active
    return active.filter(F.col("training_eligible") if view == "training" else ~F.col("training_eligible"))


def with_ids_present(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """The rows with the given ids, all of which must exist."""
    held = df.filter(F.col(key).isin(*ids))
    if missing := set(ids) - {r[0] for r in held.select(key).distinct().collect()}:
        raise ValueError(f"missing ids: {sorted(missing)}")
    return held


def function_word_ratio(text: Column, words: Sequence[str]) -> Column:
    """Share of the text's letter runs that are function words; no words: 0."""
    share = lambda found: F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: w.isin(*words))) / F.size(found)).otherwise(F.lit(0.0))
    return T.let(T.letter_words(text), share)


def character_ratio(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.lit(1), F.length(text))


def hyphenated_line_ends(text: Column) -> Column:
    return F.size(F.filter(T.filled_lines(text), lambda x: F.endswith(F.rtrim(x), F.lit("-"))))


def quality_flags(text: Column, words: Sequence[str], min_characters: int = 200, min_function_words: float = 0.2) -> Column:
    """What speaks against a text: its length, its language, its characters, page markers, broken lines."""
    n_lines = F.size(T.filled_lines(text))
    return flags({
        "too_short": F.length(text) < min_characters,
        "low_function_word_ratio": function_word_ratio(text, words) < min_function_words,
        "low_alphabetic_character_ratio": character_ratio(text, r"\p{L}") < 0.55,
        "replacement_characters": F.contains(text, F.lit("�")),
        "high_digit_character_ratio": character_ratio(text, r"\p{Nd}") > 0.03,
        "page_markers": T.count_of(text, T.PAGE_MARKER) > F.greatest(F.lit(10), n_lines * 0.01),
        "possible_line_hyphenation": hyphenated_line_ends(text) > F.greatest(F.lit(100), n_lines * 0.08),
    })


def post_clean_guards(text: Column, markers: Sequence[str], min_characters: int = 200) -> Column:
    """Names of the guards that a cleaned text fails."""
    low = F.lower(text)
    return flags({"too_short": F.length(text) < min_characters} | {f"marker:{m}": F.contains(low, F.lit(m.lower())) for m in markers})


def blocked(flag_array: Column, prefixes: Sequence[str] = ("review_",)) -> Column:
    """Whether a flag starts with one of the prefixes."""
    return F.exists(flag_array, lambda f: F.greatest(*[F.startswith(f, F.lit(p)) for p in [*prefixes, prefixes[0]]]))


def surface_screen(text: Column) -> Column:
    """What can be seen of a generated poem's form."""
    markers = flags({name: F.regexp_like(text, F.lit(p)) for name, p in META_TEXT.items()})
    longest, repetition = T.longest_line(text), T.character_variety(text, 4)["repeated"]
    n_lines, shape = T.non_empty_line_count(text), T.stanza_pattern(text)
    free, ends = F.size(markers) == 0, T.ends_with_terminal(text)
    return F.struct(
        markers.alias("meta_text_markers"),
        free.alias("meta_text_free"),
        ends.alias("ends_with_terminal"),
        longest.alias("longest_line"),
        (longest < LONG_LINE).alias("no_long_line"),
        (repetition < HIGH_REPETITION).alias("low_repetition"),
        (n_lines == POEM_LINES).alias("fourteen_lines"),
        F.coalesce(shape == F.array(F.lit(4), F.lit(4), F.lit(3), F.lit(3)), F.lit(False)).alias("stanzas_4433"),
        (free & ends & (longest < LONG_LINE) & (repetition < HIGH_REPETITION) & (n_lines == POEM_LINES)).alias("passes"),
    )


def hard_screen(text: Column, opening: Column, risk: Column) -> Column:
    """Names of the failed checks of a generated candidate; none: it may be paired."""
    held, lines = surface_screen(text), F.transform(T.filled_lines(text), T.strip)
    return flags({
        "exact_opening": ~F.startswith(text, opening),
        "exact_fourteen_lines": ~held["fourteen_lines"],
        "meta_text_free": ~held["meta_text_free"],
        "complete_terminal_syntax": ~held["ends_with_terminal"],
        "no_repeated_line_collapse": F.size(lines) != F.size(F.array_distinct(lines)),
        "no_very_long_line": ~held["no_long_line"],
        "below_repetition_threshold": ~held["low_repetition"],
        "no_high_risk_memorization": risk == "high",
    })


def risk_band(contained: Column, common: Column) -> Column:
    """high, medium or low by containment and longest common substring."""
    return decide([((contained >= 0.30) | (F.coalesce(common, F.lit(0)) >= 160), "high"), ((contained >= 0.15) | (F.coalesce(common, F.lit(0)) >= 80), "medium")], "low")


def poem_layout(text: Column) -> Column:
    """Fourteen full-length lines, the first with an upper-case first letter."""
    held = T.filled_lines(text)
    letters = F.transform(held, lambda x: F.regexp_count(x, F.lit(r"\p{L}")))
    mean = F.aggregate(letters, F.lit(0), lambda a, x: a + x) / F.size(letters)
    first = F.regexp_extract(F.coalesce(F.try_element_at(held, F.lit(1)), F.lit("")), r"(\p{L})", 1)
    return F.coalesce((F.size(held) == POEM_LINES) & first.rlike(r"^\p{Lu}$") & (F.array_min(letters) >= 22) & (mean >= 25) & (mean <= 38), F.lit(False))


def structural_issues(df: DataFrame, key: str, text: str, lines: int = POEM_LINES) -> DataFrame:
    """(key, code, detail): one row for each issue of a text's structure."""
    t = F.col(text)
    held = T.lines(t)
    lengths = F.transform(held, lambda x: F.length(T.strip(x)))
    issue = lambda rule, code, detail: F.when(rule, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    found = [
        issue(F.size(held) != lines, "line_count", F.concat(F.lit("found "), F.size(held).cast("string"), F.lit(" lines"))),
        issue(F.exists(lengths, lambda n: n == 0), "empty_line", F.lit("contains an empty line")),
        issue(F.contains(t, F.lit("\r")), "carriage_return", F.lit("contains carriage returns")),
        issue(~F.endswith(t, F.lit("\n")), "terminal_newline", F.lit("missing terminal newline")),
        issue(t.rlike(r"[\x00-\x08\x0B-\x1F]"), "control_character", F.lit("contains a control character")),
        *[issue(T.count_of(t, p) > 0, f"marker:{name}", F.concat(F.lit("found "), T.count_of(t, p).cast("string"), F.lit(" occurrence(s)"))) for name, p in SUSPICIOUS.items()],
        issue(F.exists(lengths, lambda n: n > LONG_LINE), "long_line", F.lit("contains a line over 120 characters")),
        issue(F.exists(lengths, lambda n: n < 4), "short_line", F.lit("contains a line under 4 characters")),
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("_i")).select(key, "_i.code", "_i.detail")


def gates(aggregates: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row of gate outcomes; null means not evaluated, and `passed` needs every gate to be true."""
    held = aggregates.select(*[r.alias(n) for n, r in rules.items()])
    every = F.lit(True)
    for name in rules:
        every = every & F.coalesce(F.col(name), F.lit(False))
    return held.withColumn("passed", every)


VOTE_SCHEMA = "pair_id string, preference string, scores_a array<int>, scores_b array<int>, evidence string"


def votes(df: DataFrame, payload: str, schema: str = VOTE_SCHEMA) -> DataFrame:
    """df with the parsed vote and whether it is valid: preference A or B, scores from 1 to 5, evidence given."""
    parsed = F.from_json(payload, schema)
    in_range = lambda a: F.coalesce(F.forall(a, lambda x: (x >= 1) & (x <= 5)), F.lit(False)) & (F.size(a) == 6)
    valid = parsed["preference"].isin("A", "B") & in_range(parsed["scores_a"]) & in_range(parsed["scores_b"]) & (T.strip(parsed["evidence"]) != "")
    return df.withColumn("vote", parsed).withColumn("vote_valid", F.coalesce(valid, F.lit(False)))


def comparable(a: str, b: str, fields: Mapping[str, object]) -> Column:
    """Whether two configuration structs agree in the fields, missing ones taken at their defaults."""
    out = F.lit(True)
    for name, default in fields.items():
        out = out & F.coalesce(F.col(f"{a}.{name}"), F.lit(default)).eqNullSafe(F.coalesce(F.col(f"{b}.{name}"), F.lit(default)))
    return out


def rewrite_path(path: Column, old: str, new: str) -> Column:
    """A path under another root."""
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def append_note(notes: Column, note: Column) -> Column:
    return F.concat_ws("; ", F.nullif(notes, F.lit("")), note)
