r"""Chat formatting of reply trees (operator 1), with DataFrame functions only.

Messages form trees by their parents. Iterative self-joins enumerate every root-to-leaf path: the
jump table holds each message's 2^k-th ancestor and is joined with itself, and the paths found so
far are extended by it, so a path of n messages takes log2(n) rounds and the work follows the size
of the paths. Branches are ranked by the mean score of their messages, and each chosen path becomes
one conversation.

The template is `<|start|>role<|message|>text<|end|>` for each turn. Inside roles and texts a
backslash is doubled, and a backslash goes behind the first character of every control string of
this template and of common chat formats; `unescape` is the exact inverse. The result holds the
formatted conversation and the same text in segments, each with a flag that says whether it counts
for the loss: the texts of assistant turns, nothing else.

Defined cases: null roles and texts count as empty; a message whose parent is null or missing is a
root; a message in a reply cycle, or below one, has no root and so no path; repeated message ids
within a tree are the caller's to resolve (`linear_tree` numbers turns itself, ties by role and text,
so repeated rows are turns of their own); a null tree id is a tree of its own; very long
conversations take more rounds but no task holds more than one conversation; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._common import cut, table

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: First character and rest of every control string.
CONTROL = r"([<\[])(\|[a-z_]+\|>|/?s>|</?SYS>>|/?INST\])"
LOSS_ROLE = "assistant"
#: Branches of a tree that become conversations, by rank.
BRANCHES = 1
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    r"""The text without control strings; null: empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    r"""The inverse of escape."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(turns: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of conversations whose turns follow one another."""
    named = turns.select(F.col(tree).alias("tree"), F.col(order), "role", "text")
    at = F.row_number().over(W.partitionBy("tree").orderBy(order, "role", "text")).cast("long")
    numbered = named.withColumn("node", at)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))  # a single branch: any score ranks it first


def reply_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, node, up): the messages of each chosen root-to-leaf path, `up` steps above its leaf.

    best: so many branches of each tree, by mean score, then by leaf id; None: all."""
    links = cut(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    same = F.expr("c.tree <=> p.tree and c.parent = p.node")
    jumps = cut(links.alias("c").join(links.alias("p"), same).select("c.tree", "c.node", F.col("c.parent").alias("above")))
    inner = jumps.select("tree", F.col("above").alias("node")).distinct()
    leaves = links.alias("c").join(inner.alias("i"), F.expr("c.tree <=> i.tree and c.node = i.node"), "left_anti")
    leaves = cut(leaves.select("tree", F.col("node").alias("leaf")))
    found = [leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))]
    roots = links.alias("c").join(jumps.alias("j"), F.expr("c.tree <=> j.tree and c.node = j.node"), "left_anti").select("tree", "node")

    step, rounds = 1, max(1, links.count()).bit_length() + 1
    while rounds and not jumps.isEmpty():
        so_far = found[0]
        for more in found[1:]:
            so_far = so_far.unionAll(more)
        on = F.expr("a.tree <=> b.tree and a.node = b.node")
        found.append(cut(so_far.alias("a").join(jumps.alias("b"), on).select("a.tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))))
        on = F.expr("a.tree <=> b.tree and a.above = b.node")
        jumps = cut(jumps.alias("a").join(jumps.alias("b"), on).select("a.tree", "a.node", "b.above"))
        step, rounds = 2 * step, rounds - 1
    paths = found[0]
    for more in found[1:]:
        paths = paths.unionAll(more)

    rooted = paths.alias("a").join(roots.alias("r"), F.expr("a.tree <=> r.tree and a.node = r.node")).select("a.tree", "a.leaf", "a.up")
    if best is not None:
        scored = paths.alias("a").join(links.alias("m"), F.expr("a.tree <=> m.tree and a.node = m.node"))
        scored = scored.groupBy("a.tree", "a.leaf").agg(F.avg("score").alias("_score"))
        scored = scored.alias("s").join(rooted.alias("r"), F.expr("s.tree <=> r.tree and s.leaf = r.leaf")).select("s.*")
        ranked = scored.withColumn("_rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("_score"), "leaf")))
        rooted = ranked.filter(F.col("_rank") <= best).select("tree", "leaf")
    chosen = F.expr("a.tree <=> r.tree and a.leaf = r.leaf")
    return paths.alias("a").join(rooted.alias("r"), chosen, "left_semi")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, segments, formatted): one row for each path."""
    turns = paths.alias("a").join(messages.alias("m"), F.expr("a.tree <=> m.tree and a.node = m.node"))
    role = F.coalesce(F.col("m.role"), F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(MESSAGE))
    turn = F.struct((-F.col("up")).alias("at"), head.alias("head"), escape(F.col("m.text")).alias("body"), (role == LOSS_ROLE).alias("loss"))
    held = turns.groupBy("a.tree", "a.leaf").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of = lambda t: F.array(part(t["head"], F.lit(False)), part(t["body"], t["loss"]), part(F.lit(END), F.lit(False)))
    segments = F.flatten(F.transform("_turns", of))
    out = held.select("tree", "leaf", F.size("_turns").cast("long").alias("n_turns"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def format_conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Every chosen root-to-leaf path of messages (tree, node, parent, role, text, score) as one conversation."""
    messages = messages.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    return format_paths(messages, reply_paths(messages, best))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.split(formatted, r"<\|end\|>")
    turn = lambda p: F.struct(
        unescape(F.substring(p[0], len(START) + 1, 1 << 30)).alias("role"), unescape(p[1]).alias("text")
    )
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: turn(F.split(t, r"<\|message\|>")))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, and what reading them back gives."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    messages = cut(linear_tree(turns.unionByName(probe)))
    out = format_conversations(messages, BRANCHES)
    said = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\|[a-z_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g') as body,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(\|[a-z_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g') as head
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|start|>') + length(head) + length('<|message|>') + length(body) + length('<|end|>')) as bigint) as formatted_chars
from escaped group by conv_id
"""
