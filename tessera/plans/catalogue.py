"""The catalogue: every query runs over whole tables. `named` registers a query with its SQL, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import dates as D
from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import compose, dedup, evaluate, relate, rules, spans, split, tokens
from tessera.sources import scans
from tessera.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def named(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CANON = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '[\t\f\v ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"""
FILLED = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))"
WORDS = "regexp_extract_all(lower(text), '[\\p{L}]+')"
LOOSE = "regexp_extract_all(translate(replace(lower(text), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}]+')"
HASH = "sha256('{salt}:' || cast(doc_id as varchar))"


def grams_sql(words: str, n: int) -> str:
    """Word n-grams of a list column."""
    return f"case when len({words}) >= {n} then list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' ')) else [] end"


# Documents ---------------------------------------------------------------------------------------


@named(f"""
with c as (select doc_id, {CANON} as t from documents),
f as (select doc_id, t, sha256(t) as fp, min(doc_id) over (partition by sha256(t)) as first from c where t <> ''),
s as (select case when first <> doc_id then 'duplicate' else 'retained' end as status, length(t) as n,
  case when first <> doc_id then '' when substr(sha256('s:' || fp), 1, 16) < '028f5c28f5c28f60' then 'validation' else 'train' end as split from f)
select status, split, count(*) as documents, cast(sum(n) as bigint) as characters from s group by 1, 2
""")
def doc_canonical_dedup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web-corpus build: canonical white space, first of equal texts, hash split, counts."""
    docs = of(spark, sf_dir, "documents").select("doc_id", T.canonical_whitespace(F.col("text")).alias("t")).filter("t <> ''")
    sized = docs.select("doc_id", T.sha(F.col("t")).alias("fp"), F.length("t").alias("n"))
    marked = dedup.keep_first(sized, F.col("fp"), "doc_id")
    retained = F.col("duplicate_of").isNull()
    part = F.when(~retained, "").when(split.below_fraction("s", F.col("fp"), 0.01), "validation").otherwise("train")
    held = marked.select(F.when(retained, "retained").otherwise("duplicate").alias("status"), part.alias("split"), "n")
    return held.groupBy("status", "split").agg(F.count("*").alias("documents"), F.sum("n").alias("characters"))


@named("""
with h as (select doc_id, cast(('0x' || substr(sha256('1337:' || cast(doc_id as varchar)), 1, 8)) as bigint) % 100 as p from documents)
select doc_id, case when p < 80 then 'train' when p < 90 then 'validation' else 'test' end as split from h
""")
def doc_hash_split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "documents").select("doc_id", split.percent_split("1337", F.col("doc_id")).alias("split"))


@named(r"""
select sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as fingerprint, array_to_string(list(doc_id order by doc_id), ',') as ids, count(*) as n,
  count(distinct source) > 1 as crosses_sources
from documents group by 1 having count(*) > 1
""")
def doc_exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = dedup.exact_groups(of(spark, sf_dir, "documents"), T.sha(T.exact_form(F.col("text"))), "doc_id", "source")
    return held.select("fingerprint", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n", F.col("crosses_splits").alias("crosses_sources"))


def _function_words_sql() -> str:
    cases = " ".join(f"when '{lang}' then {list(words)!r}".replace("(", "[").replace(")", "]") for lang, words in rules.FUNCTION_WORDS.items())
    return f"case lang {cases} else [] end"


def _by_language(build) -> Column:
    out = None
    for lang, words in rules.FUNCTION_WORDS.items():
        out = F.when(F.col("lang") == lang, build(words)) if out is None else out.when(F.col("lang") == lang, build(words))
    return out.otherwise(build(("",)))


@named(rf"""
with w as (select *, {WORDS} as ws, {FILLED} as ls from documents),
r as (select *, case when len(ws) > 0 then len(list_filter(ws, lambda x: list_contains({_function_words_sql()}, x))) / len(ws) else 0 end as fr from w)
select doc_id, array_to_string(list_filter([
  case when length(text) < 200 then 'too_short' end,
  case when fr < 0.2 then 'low_function_word_ratio' end,
  case when length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / greatest(1, length(text)) < 0.55 then 'low_alphabetic_character_ratio' end,
  case when contains(text, chr(65533)) then 'replacement_characters' end,
  case when length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) / greatest(1, length(text)) > 0.03 then 'high_digit_character_ratio' end,
  case when len(regexp_extract_all(text, '(?im)^\s*(?:pag(?:ina)?\.?|page)\s*\d+\s*$')) > greatest(10, len(ls) * 0.01) then 'page_markers' end,
  case when len(list_filter(ls, lambda x: ends_with(rtrim(x), '-'))) > greatest(100, len(ls) * 0.08) then 'possible_line_hyphenation' end
], lambda x: x is not null), ';') as flags from r
""")
def doc_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _by_language(lambda words: rules.quality_flags(F.col("text"), words))
    return of(spark, sf_dir, "documents").select("doc_id", F.array_join(flags, ";").alias("flags"))


@named(f"""
with w as (select lang, {WORDS} as ws from documents),
r as (select lang, case when len(ws) > 0 then len(list_filter(ws, lambda x: list_contains({_function_words_sql()}, x))) / len(ws) else 0 end as fr from w)
select lang, count(*) as documents, round(avg(fr), 9) as mean_ratio, round(avg(cast(fr < 0.2 as int)), 9) as low_rate from r group by 1
""")
def doc_function_word_ratio_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("lang", _by_language(lambda words: rules.function_word_ratio(F.col("text"), words)).alias("fr"))
    return held.groupBy("lang").agg(F.count("*").alias("documents"), F.round(F.avg("fr"), 9).alias("mean_ratio"), F.round(F.avg((F.col("fr") < 0.2).cast("int")), 9).alias("low_rate"))


@named(f"""
with g as (select doc_id, text, {WORDS} as ws, {FILLED} as ls,
  case when length(text) >= 4 then list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4)) else [] end as cg from documents)
select doc_id, cast(length(text) as bigint) as character_count, cast(len(ls) as bigint) as non_empty_line_count,
  round(case when length(text) > 0 then len(list_distinct(string_split(text, ''))) / length(text) else 0 end, 9) as unique_character_ratio,
  round(case when len(cg) > 0 then 1 - len(list_distinct(cg)) / len(cg) else 0 end, 9) as repetition_ratio
from g
""")
def doc_repetition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("doc_id", T.score_bundle(F.col("text"), F.lit("")).alias("s"))
    return held.select("doc_id", "s.character_count", "s.non_empty_line_count", F.round("s.unique_character_ratio", 9).alias("unique_character_ratio"), F.round("s.repetition_ratio", 9).alias("repetition_ratio"))


@named(rf"""
with g as (select doc_id, text, {FILLED} as ls,
  case when length(text) >= 4 then list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4)) else [] end as cg from documents),
s as (select doc_id, coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) as longest, len(ls) as n,
  case when len(cg) > 0 then 1 - len(list_distinct(cg)) / len(cg) else 0 end as rep,
  regexp_matches(text, '[.!?…][''"’”»)\]}}]*\s*$') as ends from g)
select doc_id, ends as ends_with_terminal, cast(longest as bigint) as longest_line, longest < 120 as no_long_line, rep < 0.35 as low_repetition, n = 14 as fourteen_lines,
  ends and longest < 120 and rep < 0.35 and n = 14 as passes from s
""")
def doc_surface_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("doc_id", rules.surface_screen(F.col("text")).alias("s"))
    return held.select("doc_id", *[f"s.{c}" for c in ("ends_with_terminal", "longest_line", "no_long_line", "low_repetition", "fourteen_lines", "passes")])


@named(r"""
with a as (select doc_id, regexp_replace(replace(text, '’', ''''), '\[([A-Za-zÀ-ÖØ-öø-ÿ])\]', '\1', 'g') as t from documents),
l as (select doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
  lambda x: x <> '' and not regexp_matches(x, '^\s*\d{1,3}\s*$') and not regexp_matches(x, '^\s*[\[\]]\s*$')) as ls from a)
select doc_id, cast(len(ls) as bigint) as lines, sha256(array_to_string(ls, chr(10)) || chr(10)) as cleaned_sha256 from l
""")
def doc_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("doc_id", T.clean_lines(F.col("text")).alias("c"))
    return held.select("doc_id", T.non_empty_line_count(F.col("c")).alias("lines"), T.sha(F.col("c")).alias("cleaned_sha256"))


@named(r"""
with l as (select doc_id, text, case when ends_with(text, chr(10)) then string_split(left(text, length(text) - 1), chr(10)) else string_split(text, chr(10)) end as ls from documents),
n as (select *, list_transform(ls, lambda x: length(trim(x))) as ns from l),
i as (
  select doc_id, 'line_count' as code, 'found ' || len(ls) || ' lines' as detail from n where len(ls) <> 14
  union all select doc_id, 'empty_line', 'contains an empty line' from n where list_contains(ns, 0)
  union all select doc_id, 'carriage_return', 'contains carriage returns' from n where contains(text, chr(13))
  union all select doc_id, 'terminal_newline', 'missing terminal newline' from n where not ends_with(text, chr(10))
  union all select doc_id, 'control_character', 'contains a control character' from n where regexp_matches(text, '[\x00-\x08\x0B-\x1F]')
  union all select doc_id, 'marker:wiki_template', 'found ' || len(regexp_extract_all(text, '\{\{|\}\}')) || ' occurrence(s)' from n where regexp_matches(text, '\{\{|\}\}')
  union all select doc_id, 'marker:wiki_link', 'found ' || len(regexp_extract_all(text, '\[\[|\]\]')) || ' occurrence(s)' from n where regexp_matches(text, '\[\[|\]\]')
  union all select doc_id, 'marker:html_or_reference', 'found ' || len(regexp_extract_all(text, '(?i)</?(?:ref|div|span|br|p)\b')) || ' occurrence(s)' from n where regexp_matches(text, '(?i)</?(?:ref|div|span|br|p)\b')
  union all select doc_id, 'marker:web_address', 'found ' || len(regexp_extract_all(text, '(?i)https?://|www\.')) || ' occurrence(s)' from n where regexp_matches(text, '(?i)https?://|www\.')
  union all select doc_id, 'marker:replacement_character', 'found ' || len(regexp_extract_all(text, chr(65533))) || ' occurrence(s)' from n where contains(text, chr(65533))
  union all select doc_id, 'long_line', 'contains a line over 120 characters' from n where list_max(ns) > 120
  union all select doc_id, 'short_line', 'contains a line under 4 characters' from n where list_min(ns) < 4)
select * from i
""")
def doc_structural_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.structural_issues(of(spark, sf_dir, "documents"), "doc_id", "text")


@named("""
with s as (select source, count(*) as documents, cast(sum(n_chars) as bigint) as n_chars from documents group by 1)
select source, documents, n_chars, round(n_chars / (select sum(n_chars) from s), 12) as n_chars_share, n_chars / (select sum(n_chars) from s) > 0.05 as over_cap from s
""")
def doc_source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = compose.sums_and_shares(of(spark, sf_dir, "documents"), ["source"], ["n_chars"])
    return held.select("source", "documents", "n_chars", F.round("n_chars_share", 12).alias("n_chars_share"), (F.col("n_chars_share") > 0.05).alias("over_cap"))


@named("""
with g as (select lang, source, grouping(lang) as gl, grouping(source) as gs, count(*) as documents, cast(sum(n_chars) as bigint) as characters
  from documents group by grouping sets ((lang), (source), (lang, source), ()))
select case when gl = 0 and gs = 0 then 'lang+source' when gl = 0 then 'lang' when gs = 0 then 'source' else 'all' end as grain, lang, source, documents, characters from g
""")
def doc_multi_grain_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = compose.grains(of(spark, sf_dir, "documents"), [["lang"], ["source"], ["lang", "source"], []], [F.count("*").alias("documents"), F.sum("n_chars").alias("characters")])
    return held.select("grain", "lang", "source", "documents", "characters")


@named("select source, count(*) as n, round(count(*) / (select count(*) from documents), 12) as share from documents group by 1 order by n desc, source limit 10")
def doc_top10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.top_share(of(spark, sf_dir, "documents"), "source").select("source", "n", F.round("share", 12).alias("share"))


@named(f"""
select doc_id, lang, source from (select *, row_number() over (partition by lang order by {HASH.format(salt="sample")}, doc_id) as r from documents) where r <= 20
""")
def doc_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return split.top_per_stratum(of(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "doc_id", 20, "sample")


@named(f"""
with r as (select doc_id, source, row_number() over (partition by source order by {HASH.format(salt="review")}, doc_id) as turn from documents)
select doc_id, source, row_number() over (order by turn, source) as position from r qualify position <= 48
""")
def doc_round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return split.round_robin(of(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 48, "review").withColumn("position", F.col("position").cast("long"))


GRAMS = f"""w as (select doc_id, {LOOSE} as ws from documents),
g as (select doc_id, unnest(list_distinct({grams_sql("ws", 8)})) as gram from w),
p as (select gram from g group by 1 having count(*) between 2 and 40),
sz as (select doc_id, count(*) as n from g group by 1),
cand as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join p using (gram) join g b using (gram) where a.doc_id < b.doc_id group by 1, 2 having count(*) >= 2),
near as (select c.a, c.b, c.shared from cand c join sz x on x.doc_id = c.a join sz y on y.doc_id = c.b where c.shared / least(x.n, y.n) >= 0.4)"""
PAIRS = f"""{GRAMS},
whole as (select n.a, n.b, count(*) as shared from near n join g x on x.doc_id = n.a join g y on y.doc_id = n.b and y.gram = x.gram group by 1, 2),
pairs as (select w.a, w.b, w.shared / x.n as a_in_b, w.shared / y.n as b_in_a from whole w join sz x on x.doc_id = w.a join sz y on y.doc_id = w.b
  where greatest(w.shared / x.n, w.shared / y.n) >= 0.8)"""


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.shingles(of(spark, sf_dir, "documents"), "doc_id", T.loose_words(F.col("text")))


@named(f"with {GRAMS} select a, b, shared from near")
def doc_near_dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.candidates(dedup.checkpointed(_grams(spark, sf_dir)))


@named(f"with {PAIRS} select a, b, round(a_in_b, 9) as a_in_b, round(b_in_a, 9) as b_in_a from pairs")
def doc_near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the SQL, which leaves out words that more than 40 rows hold: all pairs of copies and near copies of large groups."""
    held = dedup.near_pairs(of(spark, sf_dir, "documents"), T.loose_words(F.col("text")))
    return held.select("a", "b", F.round("a_in_b", 9).alias("a_in_b"), F.round("b_in_a", 9).alias("b_in_a"))


@named(f"""with recursive {PAIRS},
e as (select a, b from pairs union all select b, a from pairs),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.reach)
select doc_id, min(reach) as cluster from r group by 1""")
def doc_near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the SQL, as doc_near_dup_pairs."""
    return dedup.near_clusters(of(spark, sf_dir, "documents"), T.loose_words(F.col("text")))


@named("""
with f as (select doc_id, source, n_chars, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as fp from documents)
select fp as fingerprint, doc_id, source, n_chars from f qualify row_number() over (partition by fp order by n_chars desc, doc_id) = 1
""")
def doc_canonical_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest, then first, of equal normal forms: an aggregate, so copies combine before the shuffle."""
    docs = of(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", T.sha(T.exact_form(F.col("text"))).alias("fingerprint"))
    best = F.max_by(F.struct("doc_id", "source", "n_chars"), F.struct("n_chars", -F.col("doc_id")))
    return docs.groupBy("fingerprint").agg(best.alias("r")).select("fingerprint", "r.*")


@named(f"""
with d as (select doc_id, {LOOSE} as ws from documents), b as (select item_id, {LOOSE} as ws from benchmark),
dg as (select doc_id, unnest(list_distinct({grams_sql("ws", 8)})) as gram from d), bg as (select item_id, unnest(list_distinct({grams_sql("ws", 8)})) as gram from b),
sz as (select item_id, count(*) as denominator from bg group by 1), h as (select doc_id, item_id, count(*) as hits from dg join bg using (gram) group by 1, 2)
select doc_id, item_id, hits, denominator, round(hits / denominator, 9) as share from h join sz using (item_id) where hits / denominator >= 0.8
""")
def doc_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    watch = dedup.shingles(of(spark, sf_dir, "benchmark"), "item_id", T.loose_words(F.col("text")))
    held = dedup.contamination(_grams(spark, sf_dir), watch, "doc_id", "item_id")
    return held.withColumn("share", F.round("share", 9)).select("doc_id", "item_id", "hits", "denominator", "share")


@named(f"""
with d as (select doc_id, ' ' || array_to_string({LOOSE}, ' ') || ' ' as t from documents), b as (select item_id, ' ' || array_to_string({LOOSE}, ' ') || ' ' as t from benchmark)
select doc_id, item_id from d join b on contains(d.t, b.t) where b.t <> '  '
""")
def doc_benchmark_substring_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = of(spark, sf_dir, "documents"), of(spark, sf_dir, "benchmark").withColumnRenamed("text", "item")
    return dedup.substring_hits(docs, items, "doc_id", "item_id", "text", "item")


@named()
def doc_memorization_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against benchmark items: the nearest by shared 40-character grams."""
    said = of(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("said_id"), "text")
    return dedup.nearest_reference(said, of(spark, sf_dir, "benchmark"), "said_id", "item_id")


@named("""
with a as (select source, cast(sum(n_chars) as bigint) as n from documents group by 1),
t as (select cast(floor(sum(n) * 0.3) as bigint) as total from a),
l as (select source, n, least(2000, n) as low, n - least(2000, n) as room from a),
x as (select *, (select total from t) - (select sum(low) from l) as remaining, (select sum(room) from l) as rooms from l),
e as (select *, cast(remaining as double) * room / rooms as exact from x),
f as (select *, floor(exact) as whole, row_number() over (order by exact - floor(exact) desc, source) as r, remaining - sum(floor(exact)) over () as spare from e)
select source, n as available, cast(low + whole + case when r <= spare then 1 else 0 end as bigint) as allocated from f
""")
def doc_char_budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = dedup.checkpointed(of(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("available")))
    total = int(sources.agg(F.floor(F.sum("available") * 0.3)).first()[0])
    return split.largest_remainder(sources, "source", "available", total, 2000).select("source", "available", "allocated")


@named("""
with c as (select doc_id, text, length(text) as n, least(16, greatest(1, 3000 // 1000)) as k from documents),
s as (select *, case when n <= 3000 then 0 else unnest(range(0, k)) end as i from c where n > 3000 union all select *, 0 as i from c where n <= 3000)
select doc_id, cast(i as bigint) as chunk, cast(case when n <= 3000 then 0 else (n - 1000) * i // (k - 1) end as bigint) as start,
  cast(case when n <= 3000 then n else 1000 end as bigint) as size from s
""")
def doc_even_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.even_spans(F.col("text"), F.lit(3000), 1000)).alias("chunk", "s"))
    return held.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("s.start").cast("long").alias("start"), F.col("s.size").cast("long").alias("size"))


@named(r"""
with b as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
g as (select *, greatest(1, cast(floor(length(t) * (1 - 0.2)) as bigint)) as target from b),
f as (select *, strpos(substr(t, target + 1), chr(10)) as ahead, strpos(reverse(left(t, target)), chr(10)) as back from g),
p as (select *, case when ahead > 0 then target + ahead when back > 0 then target - back + 1 else 0 end as edge from f)
select doc_id, cast(length(regexp_replace(left(t, edge - 1), '\s+$', '')) as bigint) as train_chars, cast(length(regexp_replace(substr(t, edge), '^\s+', '')) as bigint) as validation_chars from p where edge > 0
""")
def doc_tail_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("doc_id", split.tail_holdout(F.col("text"), 0.2).alias("s")).filter("s is not null")
    return held.select("doc_id", F.length("s.train").cast("long").alias("train_chars"), F.length("s.validation").cast("long").alias("validation_chars"))


@named(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
m as (select *, not regexp_matches(line, '\S') as blank from l), k as (select *, sum(cast(blank as int)) over (partition by doc_id order by pos) as island from m)
select doc_id, row_number() over (partition by doc_id order by island) - 1 as block, count(*) as lines from k where not blank group by doc_id, island
""")
def doc_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.line_blocks(F.col("text"))).alias("block", "ls"))
    return held.select("doc_id", F.col("block").cast("long").alias("block"), F.size("ls").cast("long").alias("lines"))


@named("select unnest(regexp_extract_all(text, '\\S+|\\s+')) as pretoken, count(*) as n from documents group by 1")
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pretoken_counts(of(spark, sf_dir, "documents"), "text")


@named("""
with p as (select unnest(regexp_extract_all(text, '\\S+|\\s+')) as pretoken, count(*) as n from documents group by 1),
s as (select string_split(pretoken, '') as cs, n from p), q as (select cs, n, unnest(range(1, len(cs))) as i from s)
select cs[i] as left_symbol, cs[i + 1] as right_symbol, cast(sum(n) as bigint) as n from q group by 1, 2
""")
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.pretoken_counts(of(spark, sf_dir, "documents"), "text").select(F.split("pretoken", "").alias("symbols"), "n")
    held = tokens.pair_counts(counted.withColumnRenamed("n", "weight"), "symbols", "weight")
    return held.select(F.col("left").alias("left_symbol"), F.col("right").alias("right_symbol"), "n")


@named()
def bpe_train_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tokens.train_byte_pairs(of(spark, sf_dir, "documents"), "text", 300, ("<|end|>",))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs.merges)], "rank int, left_symbol string, right_symbol string")


@named(r"""
with n as (select doc_id, lang, len(regexp_extract_all(text, '\S+')) + 1 as n from documents),
o as (select *, cast(sum(n) over (partition by lang order by doc_id) as bigint) as behind, cast(sum(n) over (partition by lang) as bigint) as total from n),
p as (select *, behind - n as first, (total - 513) // 512 as last from o where total >= 513),
w as (select lang, doc_id, first, behind, unnest(range(greatest(0, cast(floor((first - 513) / 512.0) as bigint) + 1), least(last, (behind - 1) // 512) + 1)) as window_id from p),
t as (select lang, window_id, doc_id, least(behind, window_id * 512 + 1 + 512) - greatest(first, window_id * 512 + 1) as tokens from w)
select lang, cast(window_id as bigint) as window_id, doc_id, cast(tokens as bigint) as tokens from t where tokens > 0
""")
def token_offsets_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens and one end token for each document, streams by language, windows of 513 every 512."""
    counted = of(spark, sf_dir, "documents").select("doc_id", "lang", (F.regexp_count("text", F.lit(r"\S+")) + 1).cast("long").alias("n"))
    held = tokens.windows(tokens.offsets(counted, "lang", "doc_id", "n"), "lang", "doc_id", 513, 512)
    return held.select("lang", F.col("window").alias("window_id"), "doc_id", F.col("tokens").cast("long").alias("tokens"))


@named()
def window_capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = token_offsets_windows(spark, sf_dir).join(of(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return tokens.capped_sample(held.select("lang", "window_id", "source", "tokens"), "lang", "window_id", {"source": 0.5}, 40, "draw")


# Labels ------------------------------------------------------------------------------------------


@named("""
select source, count(*) as n, round(avg(quality), 9) as quality_rate, round(avg(toxic), 9) as toxic_rate, round(avg(n_chars), 6) as mean_chars
from documents join labels using (doc_id) group by 1
""")
def label_quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").join(of(spark, sf_dir, "labels"), "doc_id")
    out = evaluate.behaviour(held, ["source"], ["n_chars"], ["quality", "toxic"])
    return out.select("source", "n", F.round("rate_quality", 9).alias("quality_rate"), F.round("rate_toxic", 9).alias("toxic_rate"), F.round("mean_n_chars", 6).alias("mean_chars"))


@named("""
with s as (select n_chars as score, quality as y from documents join labels using (doc_id)),
p as (select a.score as sp, b.score as sn from s a, s b where a.y = 1 and b.y = 0)
select cast((select count(*) from s where y = 1) as bigint) as positives, cast((select count(*) from s where y = 0) as bigint) as negatives,
  round(avg(case when sp > sn then 1.0 when sp = sn then 0.5 else 0.0 end), 9) as auroc from p
""")
def label_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").join(of(spark, sf_dir, "labels"), "doc_id")
    return evaluate.auroc(held, "n_chars", "quality").select("positives", "negatives", F.round("auroc", 9).alias("auroc"))


@named("""
select 'missing' as side, count(*) as n from documents where doc_id not in (select doc_id from labels)
union all select 'unexpected', count(*) from labels where doc_id not in (select doc_id from documents)
""")
def label_join_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = relate.set_difference(of(spark, sf_dir, "documents"), of(spark, sf_dir, "labels"), "doc_id")
    counted = held.groupBy("side").agg(F.count("*").alias("n"))
    sides = spark.createDataFrame([("missing",), ("unexpected",)], "side string")
    return sides.join(counted, "side", "left").select("side", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@named("""
with s as (select n_chars as s, quality + 2 * toxic as q from documents join labels using (doc_id)),
p as (select case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0.0 end as credit from s a join s b on a.q > b.q)
select count(*) as pairs, round(avg(credit), 9) as concordance from p
""")
def label_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").join(of(spark, sf_dir, "labels"), "doc_id").withColumn("q", F.col("quality") + 2 * F.col("toxic"))
    return evaluate.concordance(held, "n_chars", "q").select("pairs", F.round("concordance", 9).alias("concordance"))


# Pages -------------------------------------------------------------------------------------------


@named()
def page_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "pages").select("page_id", scans.extract_text(F.col("html")).alias("t"))
    return held.select("page_id", F.length("t").alias("chars"), T.non_empty_line_count(F.col("t")).alias("lines"), T.sha(F.col("t")).alias("sha256"))


@named()
def page_links_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "pages").select("page_id", F.explode(scans.extract_links(F.col("html"))).alias("l")).select("page_id", "l.*")


@named(r"""
select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '') || lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) as url_key,
  replace(url_decode(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1)), '_', ' ') as title from pages
""")
def page_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"), T.title_from_url(F.col("url")).alias("title"))


# Conversations -----------------------------------------------------------------------------------


@named(f"""
with n as (select conv_id, turn, role, text, lag(role) over w as prev_role, lag(text) over w as prompt from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, cast(length(prompt) as bigint) as prompt_chars, cast(length(text) as bigint) as response_chars,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))[1] as first_line from n where role = 'assistant' and prev_role = 'user'
""")
def conv_prompt_response_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("conv_id").orderBy("turn")
    held = of(spark, sf_dir, "conversations").withColumns({"_r": F.lag("role").over(by), "prompt": F.lag("text").over(by)}).filter("role = 'assistant' and _r = 'user'")
    return held.select("conv_id", "turn", F.length("prompt").cast("long").alias("prompt_chars"), F.length("text").cast("long").alias("response_chars"), T.first_line(F.col("text")).alias("first_line"))


@named("""
with s as (select conv_id, turn, role from conversations),
p as (select x.conv_id, x.turn as a, y.turn as b, sha256('pair|' || x.turn || '|' || y.turn) as h from s x join s y on x.conv_id = y.conv_id and x.turn < y.turn and x.role <> y.role)
select conv_id, a, b from p qualify row_number() over (partition by conv_id order by h, a, b) = 1
""")
def conv_pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pair_candidates(of(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "pair")


@named("""
with m as (select role, conv_id, avg(length(text)) as m from conversations group by 1, 2)
select role, round(avg(m), 6) as mean, count(*) as clusters from m group by 1
""")
def conv_two_level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return evaluate.two_level_means(held, ["role"], "conv_id", "n").select("role", F.round("mean", 6).alias("mean"), "clusters")


@named()
def conv_bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return evaluate.bootstrap(held, "role", "conv_id", "n", draws=200)


# Embeddings --------------------------------------------------------------------------------------

COS = """q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 10 = 0), b as (select vec_id, embedding::double[] as e from embeddings),
c as (select q.vec_id as query, b.vec_id as neighbour, list_dot_product(q.e, b.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(b.e, b.e))) as cosine from q join b on q.vec_id <> b.vec_id),
t as (select *, row_number() over (partition by query order by cosine desc, neighbour) as rank from c qualify rank <= 5)"""


def _top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set, every tenth vector, against all vectors."""
    held = of(spark, sf_dir, "embeddings")
    return evaluate.top_k_cosine(held.filter("vec_id % 10 = 0"), held, "vec_id", "embedding", 5)


@named(f"with {COS} select query, neighbour, round(cosine, 6) as cosine, cast(rank as int) as rank from t")
def embedding_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top5(spark, sf_dir).select("query", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


@named(f"with {COS} select count(*) as n, round(avg(cast(x.label = y.label as int)), 9) as agreement from t join embeddings x on x.vec_id = t.query join embeddings y on y.vec_id = t.neighbour")
def embedding_label_knn_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = evaluate.label_agreement(_top5(spark, sf_dir), of(spark, sf_dir, "embeddings"), "vec_id", "label")
    return held.select("n", F.round("agreement", 9).alias("agreement"))


@named()
def embedding_effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = evaluate.representation(of(spark, sf_dir, "embeddings"), "label", "embedding")
    return held.select("label", F.round("effective_rank", 6).alias("effective_rank"), "rows")


# Events ------------------------------------------------------------------------------------------


@named("""
select user_id, count(*) as n, arg_min(event_id, (ts, event_id)) as first_event, arg_max(event_id, (ts, event_id)) as last_event from events group by 1
""")
def events_first_last_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = relate.first_last(of(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id"])
    return held.select("user_id", "n", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"))


@named("""
with r as (select user_id, event_id - row_number() over (partition by user_id order by event_id) as island, event_id from events)
select user_id, min(event_id) as first_event, max(event_id) as last_event, count(*) as n from r group by user_id, island
""")
def events_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    island = F.col("event_id") - F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    held = of(spark, sf_dir, "events").select("user_id", "event_id", island.alias("island"))
    return held.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n")).drop("island")


@named("""
with o as (select event_id, user_id, ts, event_type from events)
select l.event_id, r.event_id as previous_purchase from o l asof left join (select event_id, user_id, ts from o where event_type = 'purchase') r on l.user_id = r.user_id and l.ts >= r.ts
where l.event_type <> 'purchase'
""")
def events_asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = of(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    held = relate.as_of(events.filter("event_type <> 'purchase'"), bought, ["user_id"], "ts", "event_id")
    return held.select("event_id", F.col("as_of").alias("previous_purchase"))


@named("""
with b as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as opens from events),
s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as session from b)
select user_id, min(ts) as start, max(ts) + interval 30 minute as stop, count(*) as n from s group by user_id, session
""")
def events_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(of(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")


# Orders ------------------------------------------------------------------------------------------


@named("""
with o as (select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders)
select n_name as nation, count(*) as orders, round(sum(o_totalprice), 2) as revenue, round(sum(o_totalprice) / (select sum(o_totalprice) from orders), 9) as share
from o join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1
""")
def star_join_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (of(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    held = compose.sums_and_shares(joined.select(F.col("n_name").alias("nation"), "o_totalprice"), ["nation"], ["o_totalprice"])
    return held.select("nation", F.col("documents").alias("orders"), F.round("o_totalprice", 2).alias("revenue"), F.round("o_totalprice_share", 9).alias("share"))


@named("""
with k as (select event_type, cast(json_extract_string(props, '$.k') as int) as k from events)
select event_type, count(*) as n, count_if(k between 0 and 99) as in_range, cast(sum(k) as bigint) as total from k group by 1
""")
def events_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON parsed by schema, with a range check; what doesn't parse stays null."""
    held = of(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return held.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("k").between(0, 99)).alias("in_range"), F.sum("k").alias("total"))


@named("""
with b as (select event_type, time_bucket(interval 1 hour, ts) as start, value from events)
select start, start + interval 1 hour as stop, event_type, count(*) as n, round(sum(value), 6) as total from b group by 1, 2, 3
""")
def events_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return held.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")


@named("""
with o as (select o_orderkey, o_custkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders)
select a.o_orderkey, b.o_orderkey as previous_order from o a left join o b on a.o_custkey = b.o_custkey and b.r = a.r - 1
""")
def orders_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return of(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(by).alias("previous_order"))


@named("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 9) as avg_discount, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2
""")
def lineitem_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return held.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_discount"), F.count("*").alias("n"))


@named("select coalesce(nullif(o_orderpriority, ''), '(missing)') as value, count(*) as n from orders group by 1")
def order_priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.counts_by(of(spark, sf_dir, "orders"), "o_orderpriority")


@named("""
with c as (select source as grp, sum(n_chars) as v from documents group by 1)
select arg_max(grp, v) as largest, round(max(v) / sum(v), 12) as share, count(*) as groups, max(v) / sum(v) > 0.1 as reweight, count(*) * 0.1 >= 1 as feasible from c
""")
def doc_ceiling_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.ceiling(of(spark, sf_dir, "documents"), "source", "n_chars", 0.1).withColumn("share", F.round("share", 12))


@named("""
with l as (select distinct lang, source from documents)
select a.lang as "left", b.lang as "right", count(*) as shared from l a join l b on a.source = b.source and a.lang < b.lang group by 1, 2
""")
def doc_shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.shared_across(of(spark, sf_dir, "documents"), "lang", "source")


@named(r"""
with y as (select doc_id, unnest(regexp_extract_all(text, '\b(1\d{3}|20\d{2})\b')) as y from documents)
select cast(y as int) as year, count(*) as n from y group by 1
""")
def doc_year_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that are words: digits inside keys and digests, which letters touch, are none."""
    return of(spark, sf_dir, "documents").select(F.explode(D.years(F.col("text"), "0-9A-Za-z_")).alias("year")).groupBy("year").agg(F.count("*").alias("n"))


@named("""
select unnest(list_distinct(string_split(text, ''))) as char, count(*) as documents from documents group by 1
""")
def doc_character_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("char")).filter("char <> ''")
    return held.groupBy("char").agg(F.count("*").alias("documents"))
