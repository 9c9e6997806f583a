"""Joins, sets, windows, spans and votes over whole tables, each through the library's own operator, beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compose, dedup, evaluate, relate, rules, spans, split, tokens
from tessera.plans.catalogue import named, of

# Joins with contracts ----------------------------------------------------------------------------


@named("""
select c_custkey, c_name, c_nationkey, c_mktsegment, round(c_acctbal * 2, 2) as c_acctbal from customer
""")
def customer_overwrite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers with an authority's balances in place of their own."""
    customers = of(spark, sf_dir, "customer")
    authority = customers.select("c_custkey", F.round(F.col("c_acctbal") * 2, 2).alias("c_acctbal"))
    return relate.overwrite_join(customers, authority, "c_custkey")


@named("""
with r as (select case when o_orderkey % 11 = 0 then -1 - o_orderkey else o_orderkey end as o_orderkey, o_custkey, case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 7 <> 0),
j as (select coalesce(o.o_orderkey, r.o_orderkey) as o_orderkey, o.o_orderkey as a, r.o_orderkey as b, o.o_totalprice as pa, r.o_totalprice as pb from orders o full outer join r on o.o_orderkey = r.o_orderkey)
select o_orderkey, case when a is null then 'missing left' when b is null then 'missing right' else 'differs: o_totalprice' end as problem from j where a is null or b is null or pa <> pb
""")
def order_storage_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of orders against a storage that lacks, adds and changes some."""
    orders = of(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    moved = F.when(F.col("o_orderkey") % 11 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    stored = orders.filter("o_orderkey % 7 <> 0").select(moved.alias("o_orderkey"), "o_custkey", changed.alias("o_totalprice"))
    return relate.disagreements(orders, stored, "o_orderkey", ["o_custkey", "o_totalprice"])


@named("""
with a as (select doc_id, source || ':' || doc_id // 3 as k, case when doc_id % 4 = 0 then [] else [lang] end as w from documents),
b as (select doc_id as other, source || ':' || doc_id // 3 as k, [case when doc_id % 2 = 0 then lang else 'xx' end] as w from documents)
select a.doc_id, array_to_string(list(b.other order by b.other), ',') as matches from a join b using (k) where len(a.w) = 0 or list_has_any(a.w, b.w) group by 1
""")
def doc_title_author_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal title keys with a common author; no author matches any."""
    docs = of(spark, sf_dir, "documents")
    key = F.concat_ws(":", "source", F.floor(F.col("doc_id") / 3))
    none = F.array().cast("array<string>")
    left = docs.select("doc_id", key.alias("title_key"), F.when(F.col("doc_id") % 4 == 0, none).otherwise(F.array("lang")).alias("authors"))
    right = docs.select(F.col("doc_id").alias("other"), key.alias("title_key"), F.array(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("xx")).alias("authors"))
    held = relate.title_author_join(left, right, "doc_id", "other")
    return held.select("doc_id", F.array_join(F.col("matches").cast("array<string>"), ",").alias("matches"))


@named("""
select a.o_orderkey, coalesce(string_agg(cast(b.o_orderkey as varchar), ',' order by b.o_orderkey), '') as others
from orders a left join orders b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and a.o_orderkey <> b.o_orderkey group by 1
""")
def order_others_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = relate.others_with_key(of(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderpriority")
    return held.select("o_orderkey", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@named("""
select l_orderkey, array_to_string(list_sort(list(distinct s_name)), '|') as names from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey where o_orderpriority = '1-URGENT' group by 1
""")
def order_supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of what the chosen pages link to."""
    roots = of(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "l_orderkey")
    held = relate.linked_names(of(spark, sf_dir, "lineitem"), roots, of(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_orderkey", "l_suppkey", "s_name")
    return held.select("l_orderkey", F.array_join("names", "|").alias("names"))


@named("""
with l as (select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 0), c as (select c_custkey, c_name from customer where c_custkey % 5 <> 0)
select o.o_orderkey, l.o_custkey, c.c_name from orders o left join l on l.o_orderkey = o.o_orderkey left join c on c.c_custkey = l.o_custkey
""")
def order_scan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, their links and those pages; what is missing stays null."""
    orders = of(spark, sf_dir, "orders")
    links = orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey")
    pages = of(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return relate.scan_chain(orders.select("o_orderkey"), links, pages, "o_orderkey", "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@named("""
with s as (select doc_id, lang, doc_id * 37 % 50000 as start, doc_id * 37 % 50000 + n_chars as stop from documents)
select a.doc_id, b.doc_id as right_doc_id, least(a.stop, b.stop) - greatest(a.start, b.start) as overlap
from s a join s b on a.lang = b.lang and a.doc_id % 3 = 0 and b.doc_id % 3 = 1 and least(a.stop, b.stop) > greatest(a.start, b.start)
""")
def doc_range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("doc_id") * 37 % 50_000
    placed = of(spark, sf_dir, "documents").select("doc_id", "lang", start.alias("start"), (start + F.col("n_chars")).alias("stop"))
    held = relate.range_overlap(placed.filter("doc_id % 3 = 0"), placed.filter("doc_id % 3 = 1"), ["lang"], 2_000)
    return held.select("doc_id", "right_doc_id", "overlap")


@named("""
with t as (select conv_id, list(role || '-' || turn order by turn) as titles from conversations group by 1),
u as (select conv_id, unnest(titles) as title, generate_subscripts(titles, 1) as pos from t),
p as (select role || '-' || turn as title, min(text) as text from conversations where turn % 2 = 0 group by 1)
select conv_id, sha256(coalesce(string_agg(text, chr(10) order by pos), '')) as text_sha256, cast(count(*) - count(text) as bigint) as missing from u left join p using (title) group by 1
""")
def conv_transclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of listed pages in their order, with how many are missing."""
    turns = of(spark, sf_dir, "conversations").withColumn("title", F.concat_ws("-", "role", "turn"))
    pages = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "title"))), lambda x: x["title"]).alias("titles"))
    parts = turns.filter("turn % 2 = 0").groupBy("title").agg(F.min("text").alias("text"))
    held = relate.transclude(pages, parts, "conv_id", "titles", "title", "text")
    return held.select("conv_id", F.sha2("text", 256).alias("text_sha256"), "missing")


@named("""
select 'kept' as side, count(*) as n from documents where doc_id not in (select doc_id from labels where toxic = 1)
""")
def doc_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus without listed ids, all of which must exist."""
    listed = of(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    held = relate.without_ids(of(spark, sf_dir, "documents"), listed, "doc_id")
    return held.agg(F.lit("kept").alias("side"), F.count("*").alias("n"))


@named("""
with b as (select doc_id, text from documents where doc_id % 3 <> 0), n as (select doc_id, text from documents where doc_id % 2 = 0)
select doc_id, 'base' as origin from b union all
select doc_id, 'new' from n where doc_id not in (select doc_id from b) and sha256(text) not in (select sha256(text) from b)
""")
def doc_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of(spark, sf_dir, "documents").select("doc_id", "text")
    held = relate.append_new(docs.filter("doc_id % 3 <> 0").withColumn("origin", F.lit("base")), docs.filter("doc_id % 2 = 0").withColumn("origin", F.lit("new")), "doc_id", "text")
    return held.select("doc_id", "origin")


@named("select doc_id, cast(case lang when 'en' then 0 when 'de' then 1 else 2 end as int) as component from documents")
def doc_union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of(spark, sf_dir, "documents").select("doc_id", "lang")
    held = relate.union_unique([docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), docs.filter("lang not in ('en', 'de')")], "doc_id")
    return held.select("doc_id", "component")


@named("""
select sha256(coalesce(text, '')) as fp, count(*) as n from documents group by 1 having count(*) > 1
""")
def doc_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.duplicates(of(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("fp")), "fp")


# Windows and sequences ---------------------------------------------------------------------------


@named("""
with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as place from conversations where turn <> 1)
select conv_id, turn, place from p where place <> turn + 1
""")
def conv_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = of(spark, sf_dir, "conversations").filter("turn <> 1").withColumn("at", F.col("turn") + 1)
    return relate.sequence_gaps(turns, "conv_id", "at").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@named("""
select l_orderkey, l_partkey, l_linenumber, row_number() over w as occurrence, count(*) over (partition by l_orderkey) as "of" from lineitem window w as (partition by l_orderkey order by l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)
""")
def lineitem_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    held = relate.occurrences(of(spark, sf_dir, "lineitem").withColumn("at", order), "l_orderkey", "at")
    return held.select("l_orderkey", "l_partkey", "l_linenumber", F.col("occurrence").cast("long").alias("occurrence"), F.col("of").cast("long").alias("of"))


@named("""
with t as (select doc_id, source as root, case when doc_id % 10 = 0 then source when doc_id % 3 = 0 then source || '/' || lang || '/' || doc_id else source || '/' || doc_id end as title from documents),
r as (select *, case when starts_with(title, root || '/') then substr(title, length(root) + 2) else '' end as relative, row_number() over (partition by root order by title <> root, lower(title), title) as place from t)
select doc_id, relative, cast(case when relative = '' then 0 else len(string_split(relative, '/')) end as int) as depth, cast(case when relative = '' then 0 else place end as bigint) as place from r
""")
def doc_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root page first, then subpages; root pages share a title here, so their places are left out."""
    title = F.when(F.col("doc_id") % 10 == 0, F.col("source")).when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "source", "lang", "doc_id")).otherwise(F.concat_ws("/", "source", "doc_id"))
    held = relate.hierarchy(of(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("root"), title.alias("title")), "root", "title")
    return held.select("doc_id", "relative", "depth", F.when(F.col("relative") == "", 0).otherwise(F.col("place")).cast("long").alias("place"))


@named("""
with e as (select user_id, event_id, round(value, 2) as value from events)
select user_id, arg_min(event_id, (value, event_id)) as best_event, round(min(value), 2) as best_value, max(event_id) as final_event from e group by 1
""")
def events_best_and_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = of(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 2).alias("value"))
    held = evaluate.best_and_final(history, "user_id", "event_id", "value")
    return held.select("user_id", F.col("best.event_id").alias("best_event"), F.round("best.value", 2).alias("best_value"), F.col("final.event_id").alias("final_event"))


LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


@named(f"""
with {LINES} select doc_id, cast(pos as int) as pos, sha256(array_to_string(list(line) over (partition by doc_id order by pos rows between 3 preceding and 3 following), chr(10))) as context_sha256 from l
""")
def doc_line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spans.line_context(_lines(spark, sf_dir), "doc_id", "pos", "line")
    return held.select("doc_id", "pos", F.sha2(F.array_join("context", "\n"), 256).alias("context_sha256"))


@named(f"""
with {LINES}, h as (select doc_id, pos, case when length(line) between 1 and 40 then line end as heading from l)
select doc_id, cast(pos as int) as pos, last_value(heading ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as carried from h
""")
def doc_heading_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = _lines(spark, sf_dir).withColumn("heading", F.when(F.length("line").between(1, 40), F.col("line")))
    return spans.carry_forward(headed, "doc_id", "pos", "heading").select("doc_id", "pos", "carried")


@named(f"""
with {LINES}, n as (select doc_id, pos, least(3, length(line) // 60) as n from l), x as (select doc_id, pos, n, lead(n) over (partition by doc_id order by pos) as after from n)
select doc_id, cast(pos as int) as first from x where n = 1 and after = 2
""")
def doc_block_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run of 1, 2 stands among the line sizes; such runs can't overlap."""
    sizes = _lines(spark, sf_dir).select("doc_id", F.col("pos").alias("position"), F.least(F.lit(3), F.floor(F.length("line") / 60)).cast("int").alias("n"))
    return spans.block_patterns(sizes, "doc_id", (1, 2))


# Spans -------------------------------------------------------------------------------------------

SPANS = """s as (select source, doc_id * 97 % 3000 as start, doc_id * 97 % 3000 + 1 + n_chars % 40 as stop from documents),
o as (select *, max(stop) over (partition by source order by start, stop rows between unbounded preceding and 1 preceding) as reach from s),
m as (select *, sum(case when reach is null or start {over} reach then 1 else 0 end) over (partition by source order by start, stop rows unbounded preceding) as island from o),
g as (select source, min(start) as start, max(stop) as stop from m group by source, island)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("doc_id") * 97 % 3_000
    return of(spark, sf_dir, "documents").select("source", start.alias("start"), (start + 1 + F.col("n_chars") % 40).alias("stop"))


@named(f"with {SPANS.format(over='>')} select * from g")
def span_merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge(_spans(spark, sf_dir), "source")


@named(f"with {SPANS.format(over='>=')} select * from g")
def span_merge_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge(_spans(spark, sf_dir), "source", touching=False)


@named(f"""
with {SPANS.format(over='>')}, x as (select source, start, stop from g union all select distinct source, 4000, 4000 from documents),
k as (select source, coalesce(lag(stop) over (partition by source order by start, stop), 0) as start, start as stop, true as kept from x)
select * from k where stop > start union all select source, start, stop, false from g
""")
def span_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = of(spark, sf_dir, "documents").select("source").distinct().withColumn("length", F.lit(4_000).cast("long"))
    return spans.complement(spans.merge(_spans(spark, sf_dir), "source"), lengths, "source")


@named("""
select doc_id, sha256(left(text, 10) || '|' || substr(text, 21)) as rest_sha256 from documents where length(text) > 20
""")
def doc_span_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of(spark, sf_dir, "documents").filter(F.length("text") > 20).select("doc_id", "text")
    out = docs.select("doc_id", F.lit(10).alias("start"), F.lit(20).alias("stop"))
    return spans.remove(docs, out, "doc_id", "text", "|").select("doc_id", F.sha2("text", 256).alias("rest_sha256"))


@named("""
with s as (select conv_id, turn * 10 as start, case when turn = 1 then turn * 10 + 9 else turn * 10 + 10 end as stop, max(turn) over (partition by conv_id) * 10 + 10 as whole from conversations),
n as (select *, coalesce(lag(stop) over w, 0) as before, lead(start) over w as after from s window w as (partition by conv_id order by start, stop))
select conv_id, start, stop from n where start <> before or (after is null and stop <> whole)
""")
def conv_coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = of(spark, sf_dir, "conversations")
    longest = turns.groupBy("conv_id").agg((F.max("turn") * 10 + 10).alias("whole"))
    stop = F.when(F.col("turn") == 1, F.col("turn") * 10 + 9).otherwise(F.col("turn") * 10 + 10)
    placed = turns.join(longest, "conv_id").select("conv_id", (F.col("turn") * 10).alias("start"), stop.alias("stop"), "whole")
    return spans.coverage_violations(placed, "conv_id", "whole").select("conv_id", "start", "stop")


# Counts, caps and plans --------------------------------------------------------------------------


@named("""
with s as (select 'source' as grain, source as name, sum(n_chars) / (select sum(n_chars) from documents) as share, 0.05 as cap from documents group by source
  union all select 'lang', lang, sum(n_chars) / (select sum(n_chars) from documents), 0.3 from documents group by lang)
select grain, name, round(share, 12) as share from s where share > cap
""")
def doc_cap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = compose.cap_violations(of(spark, sf_dir, "documents"), {"source": 0.05, "lang": 0.3}, "n_chars")
    return held.withColumn("share", F.round("share", 12))


@named("""
with d as (select source, n_chars, case when doc_id % 5 = 0 then 'exclude_short' when doc_id % 5 < 3 then 'train_core' else 'hold_review' end as decision from documents)
select source, count(*) as "rows", cast(sum(n_chars) as bigint) as characters, cast(coalesce(sum(n_chars) filter (not starts_with(decision, 'exclude_')), 0) as bigint) as retained_characters,
  cast(coalesce(sum(n_chars) filter (starts_with(decision, 'train')), 0) as bigint) as training_characters from d group by 1
""")
def doc_decision_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("doc_id") % 5 == 0, "exclude_short").when(F.col("doc_id") % 5 < 3, "train_core").otherwise("hold_review")
    return compose.decisions(of(spark, sf_dir, "documents").withColumn("decision", decision), ["source"], "n_chars", "decision")


@named("""
with a as (select c_nationkey, c_mktsegment || case when c_custkey % 3 = 0 then ', X' else '' end as label from customer), n as (select c_nationkey, label, count(*) as n from a group by 1, 2)
select c_nationkey, label, n, first_value(label) over (partition by c_nationkey order by contains(label, ','), length(label), lower(label), label) as representative from n
""")
def customer_alias_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, ", X").otherwise(""))
    return compose.alias_ledger(of(spark, sf_dir, "customer").withColumn("label", label), "c_nationkey", "label").select("c_nationkey", "label", "n", "representative")


@named("""
select o_custkey, count(distinct o_orderstatus) as variants from orders group by 1 having count(distinct o_orderstatus) > 1
""")
def order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.distinct_or_conflict(of(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "o_custkey")


@named("""
with t as (select lang, sum(n_chars) as n from documents group by 1), p as (select n as p from t where lang = 'en')
select lang, cast(floor(p / 0.5 * (case lang when 'en' then 0.5 when 'de' then 0.3 else 0.2 end) / 512) * 512 as bigint) as budget from t, p where lang in ('en', 'de', 'fr')
""")
def doc_stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = of(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("n"))
    return compose.stage_plan(totals, "lang", "n", "en", {"en": 0.5, "de": 0.3, "fr": 0.2}, 512)


@named("""
with g as (select source, sum(n_chars) as v from documents where doc_id % 2 = 0 group by 1)
select arg_max(source, v) as largest, round(max(v) / sum(v), 12) as share from g
""")
def doc_exposure_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.concentration(of(spark, sf_dir, "documents").filter("doc_id % 2 = 0"), "source", "n_chars").withColumn("share", F.round("share", 12))


@named("""
with d as (select doc_id, source, case when doc_id % 3 = 0 and source <> 'src1' then n_chars end as measured from documents), m as (select median(measured) as med from d)
select doc_id, round(coalesce(measured, avg(measured) over (partition by source), med), 6) as estimate from d, m
""")
def doc_size_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = F.when((F.col("doc_id") % 3 == 0) & (F.col("source") != "src1"), F.col("n_chars"))
    return compose.estimated(of(spark, sf_dir, "documents").withColumn("measured", measured), "measured", "source").select("doc_id", F.round("estimate", 6).alias("estimate"))


@named("""
select event_type, max(event_id) as updates, round(avg(value), 6) as mean_loss, arg_max(user_id, event_id) as elapsed from events group by 1
""")
def events_stage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.stage_completeness(of(spark, sf_dir, "events"), "event_type", "event_id", "value", "user_id").withColumn("mean_loss", F.round("mean_loss", 6))


@named("""
select sha256(string_agg(cast(doc_id as varchar) || chr(0) || sha256(text) || chr(10), '' order by cast(doc_id as varchar))) as digest from documents
""")
def doc_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of a whole corpus, by definition in id order: over ids and hashes, not texts."""
    return compose.digest(of(spark, sf_dir, "documents"), "doc_id", F.sha2("text", 256))


@named("""
with c as (select unnest(string_split(lang || ' | ' || source, ' | ')) as label, n_chars from documents)
select label, cast(sum(n_chars) as bigint) as weight, round(sum(n_chars) / (select sum(n_chars) from documents), 12) as share from c group by 1 order by weight desc, label limit 8
""")
def doc_split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    held = compose.split_labels(of(spark, sf_dir, "documents").withColumn("cell", F.concat_ws(" | ", "lang", "source")), "cell", "n_chars", 8)
    return held.withColumn("share", F.round("share", 12))


# Evaluation --------------------------------------------------------------------------------------


@named("select doc_id, quality as quality, toxic as toxic, toxic - quality as delta from labels")
def label_paired_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states over the same cells, joined cell by cell."""
    labels = of(spark, sf_dir, "labels")
    long = labels.select("doc_id", F.lit("quality").alias("state"), F.col("quality").alias("v")).unionAll(labels.select("doc_id", F.lit("toxic"), "toxic"))
    return evaluate.paired(long, "state", ["doc_id"], "quality", "toxic", "v")


@named("""
with c as (select user_id, count(distinct event_type) as states from events group by 1) select user_id, states from c where states < (select count(distinct event_type) from events)
""")
def events_grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.grid_gaps(of(spark, sf_dir, "events"), "event_type", ["user_id"])


VOTES = "v as (select l_orderkey as pair, l_linenumber as judge, case when l_partkey % 5 < 2 then 'A' when l_partkey % 5 < 4 then 'B' else 'tie' end as preference from lineitem)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    preference = F.when(F.col("l_partkey") % 5 < 2, "A").when(F.col("l_partkey") % 5 < 4, "B").otherwise("tie")
    return of(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("judge"), preference.alias("preference"))


@named(f"""
with {VOTES}, c as (select pair, count_if(preference = 'A') as a, count_if(preference = 'B') as b, count(*) as votes from v group by 1)
select pair, case when a >= 2 then 'A' when b >= 2 then 'B' else 'no_majority' end as majority, a = votes or b = votes as unanimous, votes from c
""")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.majority(_votes(spark, sf_dir), "pair", "preference")


@named(f"""
with {VOTES}, j as (select distinct judge from v), p as (select o_orderkey as pair from orders)
select pair, judge from p, j except select pair, judge from v
""")
def vote_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    pairs = of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"))
    return evaluate.complete_votes(pairs, votes.select("judge").distinct(), votes, "pair", "judge")


@named(f"with {VOTES} select pair, judge, preference, o_custkey, o_orderstatus, count(*) as n from v join orders on o_orderkey = pair group by all")
def vote_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes with their public pair and its private mapping."""
    orders = of(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "pair")
    held = evaluate.judged_votes(_votes(spark, sf_dir), orders.select("pair", "o_custkey"), orders.select("pair", "o_orderstatus"), "pair")
    return held.groupBy("pair", "judge", "preference", "o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


@named("""
select n_name, r_name, l as lang from nation, region, (select distinct lang as l from documents)
""")
def condition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of short axes: that is the feature."""
    return evaluate.grid(of(spark, sf_dir, "nation").select("n_name"), of(spark, sf_dir, "region").select("r_name"), of(spark, sf_dir, "documents").select("lang").distinct())


@named("select p_partkey, p_retailprice, p_size from part where p_size <= 20 order by p_retailprice desc, p_size, p_partkey limit 1")
def part_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row that fits: one by definition."""
    parts = of(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("cost", F.struct("p_size", "p_partkey"))
    return evaluate.best_fit(parts, F.col("p_size") <= 20, "p_retailprice", "cost").drop("cost")


# Copies ------------------------------------------------------------------------------------------


@named("""
with f as (select doc_id, source, n_chars, sha256(text) as fp from documents)
select fp, doc_id, n_chars from f qualify row_number() over (partition by fp order by n_chars desc, doc_id desc) = 1
""")
def doc_family_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("fp"))
    return dedup.winner(docs, F.col("fp"), F.desc("n_chars"), F.desc("doc_id")).select("fp", "doc_id", "n_chars")


@named("""
with f as (select doc_id, lang, sha256(text) as fp, cast(substr(source, 4) as int) as rank from documents)
select doc_id, first_value(doc_id) over (partition by fp order by rank, doc_id) as winner, (select count(distinct g.lang) from f g where g.fp = f.fp) > 1 as crosses_roles from f
""")
def doc_provenance_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("fp"), F.substring("source", 4, 9).cast("int").alias("rank"))
    return dedup.provenance_winner(docs, "fp", "lang", "rank", "doc_id").select("doc_id", "winner", "crosses_roles")


# Samples and splits ------------------------------------------------------------------------------


@named("""
with g as (select distinct source from documents), r as (select source, row_number() over (order by sha256('g|' || source), source) as r, count(*) over () as n from g)
select doc_id, case when r <= greatest(1, round_even(n * 0.3, 0)) then 'validation' else 'train' end as split from documents join r using (source)
""")
def doc_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.grouped_split(of(spark, sf_dir, "documents"), "source", "g", 0.3).select("doc_id", "split")


@named("""
with a as (select source, cast(sum(n_chars) as bigint) as n from documents group by 1), t as (select cast(floor(sum(n) * 0.25) as bigint) as total from a),
l as (select source, n, least(3000, n) as low from a), s as (select *, greatest(0, (select total from t) - sum(low) over ()) as remaining, sum(n - low) over () as rooms from l),
w as (select *, low + least(floor(cast(remaining as double) * (n - low) / rooms), n - low) as whole from s), x as (select *, n - whole as room, greatest(0, (select total from t) - sum(whole) over ()) as rest from w),
y as (select *, coalesce(sum(room) over (order by source rows between unbounded preceding and 1 preceding), 0) as before from x)
select source, cast(whole + greatest(0, least(room, rest - before)) as bigint) as allocated from y
""")
def doc_in_order_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = dedup.checkpointed(of(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("available")))
    total = int(sources.agg(F.floor(F.sum("available") * 0.25)).first()[0])
    return split.in_order_allocation(sources, "source", "available", total, 3_000).select("source", "allocated")


@named("""
with r as (select doc_id, source, (row_number() over (partition by source order by doc_id) - 0.5) / count(*) over (partition by source) as place from documents)
select doc_id, source, round(place, 12) as place from r
""")
def doc_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.interleave(of(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").withColumn("place", F.round("place", 12))


@named("""
with t as (select doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from documents), n as (select doc_id, len(w) as n, least(greatest(1, cast(floor(len(w) * 0.1) as int)), len(w) - 1) as held from t)
select doc_id, cast(n - held as int) as train, cast(held as int) as validation from n where n >= 2
""")
def doc_tail_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    held = of(spark, sf_dir, "documents").select("doc_id", split.tail_tokens(words, 0.1).alias("s")).filter("s is not null")
    return held.select("doc_id", F.size("s.train").alias("train"), F.size("s.validation").alias("validation"))


@named("""
with e as (select doc_id, unnest(range(0, n_chars - 200 + 1, 512)) as o from documents where n_chars >= 200),
c as (select *, row_number() over (partition by doc_id order by sha256('p:' || doc_id || ':' || o), o) - 1 as cycle from e)
select doc_id, cast(o as bigint) as "offset", cast(cycle as int) as cycle from c order by cycle, sha256('p:' || doc_id), doc_id limit 60
""")
def doc_probe_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return split.probe_cycles(of(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 60, 200, 512, "p")


@named("""
select doc_id, cast(i as bigint) as block, greatest(0, i * 256 - 128) as start, least(n_chars, (i + 1) * 256) as stop, i * 256 as label_start from (select doc_id, n_chars, unnest(range(0, (n_chars - 1) // 256 + 1)) as i from documents where n_chars > 0)
""")
def doc_continuation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = of(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens.continuation_windows(F.col("n_chars"), 128, 256)).alias("block", "w"))
    return held.select("doc_id", F.col("block").cast("long").alias("block"), "w.start", "w.stop", "w.label_start")


@named("select cast(sum(length(text)) as bigint) as tokens from documents")
def doc_token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an encoder of one token to a character, run on each distinct pretoken once."""
    characters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return tokens.token_total(of(spark, sf_dir, "documents"), "text", characters)


@named("""
with c as (select distinct unnest(string_split(text, '')) as char from documents) select char, row_number() over (order by encode(char)) - 1 as id from c where char <> ''
""")
def doc_character_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.characters(of(spark, sf_dir, "documents"), "text").withColumn("id", F.col("id").cast("long"))


@named("""
with w as (select unnest(list_transform(regexp_extract_all(text, '\\S+'), lambda x: length(x))) as token from documents), i as (select unnest([1, 2, 3, 5, 400]) as token)
select cast(i.token as int) as token, count(w.token) as n from i left join w on w.token = i.token group by 1
""")
def doc_selected_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often chosen ids occur, zeros kept; the ids here are word lengths."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)")), lambda w: F.length(w))
    return tokens.selected_frequency(of(spark, sf_dir, "documents").select(lengths.alias("ids")), "ids", [1, 2, 3, 5, 400])


@named("""
with p as (select doc_id, [1, length(lang)] as prompt, [length(source), n_chars] as answer from documents)
select doc_id, array_to_string(list_concat(list_concat(prompt, answer), [2]), ',') as input_ids, array_to_string(list_concat(list_concat([-100, -100], answer), [2]), ',') as labels from p
""")
def doc_supervised_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt labels are masked."""
    prompt = F.array(F.lit(1).cast("long"), F.length("lang").cast("long"))
    answer = F.array(F.length("source").cast("long"), F.col("n_chars"))
    held = of(spark, sf_dir, "documents").select("doc_id", tokens.supervised(prompt, answer, 2).alias("e"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return held.select("doc_id", text("e.input_ids").alias("input_ids"), text("e.labels").alias("labels"))


# Manifests and rules -----------------------------------------------------------------------------


@named("""
select doc_id from documents where doc_id % 3 <> 0 and doc_id % 5 = 1 and doc_id % 7 <> 0
""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string manifest's rows of one data set and split that have a text."""
    as_text = F.when(F.col("doc_id") % 3 != 0, "True").otherwise("False")
    part = F.when(F.col("doc_id") % 5 == 1, "validation").otherwise("train")
    path = F.when(F.col("doc_id") % 7 != 0, F.concat_ws("/", "source", "doc_id")).otherwise("")
    df = of(spark, sf_dir, "documents").select("doc_id", as_text.alias("include_in_core"), part.alias("split_core"), path.alias("clean_text_path"))
    return rules.manifest_filter(df, "core", "validation").select("doc_id")


@named("""
select doc_id, view from (select doc_id, doc_id % 4 <> 0 as active, doc_id % 3 <> 0 as eligible, unnest(['training', 'protected', 'all']) as view from documents)
where active and (view = 'all' or (view = 'training') = eligible)
""")
def active_units_by_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = of(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, "active").otherwise("hold").alias("activation_status"), (F.col("doc_id") % 3 != 0).alias("training_eligible"))
    out = None
    for view in ("training", "protected", "all"):
        held = rules.active_units(units, view).select("doc_id", F.lit(view).alias("view"))
        out = held if out is None else out.unionAll(held)
    return out


@named("""
select case when doc_id % 40 / 100.0 >= 0.3 or n_chars >= 4000 then 'high' when doc_id % 40 / 100.0 >= 0.15 or n_chars >= 2000 then 'medium' else 'low' end as risk, count(*) as n from documents group by 1
""")
def doc_risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = rules.risk_band(F.col("doc_id") % 40 / 100.0, F.floor(F.col("n_chars") / 25))
    return of(spark, sf_dir, "documents").groupBy(band.alias("risk")).agg(F.count("*").alias("n"))


@named(r"""
select doc_id, array_to_string(list_filter([case when length(text) < 200 then 'too_short' end, case when contains(lower(text), 'license') then 'marker:License' end, case when contains(lower(text), 'idiot') then 'marker:idiot' end], lambda x: x is not null), ';') as failed from documents
""")
def doc_post_clean_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = rules.post_clean_guards(F.col("text"), ["License", "idiot"])
    return of(spark, sf_dir, "documents").select("doc_id", F.array_join(held, ";").alias("failed"))


@named("""
with a as (select count(*) as n, avg(toxic) as toxic, cast(null as double) as unknown from labels)
select n > 10 as enough, toxic < 0.5 as mostly_clean, unknown > 0 as not_evaluated, false as passed from a
""")
def label_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued gates over aggregates: one that can't be evaluated doesn't pass."""
    aggregates = of(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.avg("toxic").alias("toxic"), F.lit(None).cast("double").alias("unknown"))
    return rules.gates(aggregates, {"enough": F.col("n") > 10, "mostly_clean": F.col("toxic") < 0.5, "not_evaluated": F.col("unknown") > 0})


@named("""
select event_id, coalesce(k % 3 < 2 and k between 0 and 95, false) as valid from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)
""")
def events_vote_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes as JSON: preference A or B, six scores from 1 to 5 for each side, evidence given."""
    k = F.from_json("props", "k int")["k"]
    preference = F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("tie")
    score = F.when(k > 95, F.lit(6)).otherwise(F.lit(3))
    payload = F.to_json(F.struct(preference.alias("preference"), F.array_repeat(score, 6).alias("scores_a"), F.array_repeat(F.lit(1), 6).alias("scores_b"), F.lit("seen").alias("evidence")))
    held = rules.votes(of(spark, sf_dir, "events").withColumn("payload", payload), F.col("payload"))
    return held.select("event_id", F.col("vote_valid").alias("valid"))
