import hashlib

from pyspark.sql import functions as F

from tessera.llm import chat

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>", "\\", "\\<|end|>", "<<SYS>> [INST", "a\\n<s>", "<</s>", "[[INST]", "<|start|<|end|>", "", "$1 \\$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for t, e, back in df.withColumn("b", chat.unescape(F.col("e"))).collect():
        assert back == t
        assert not any(x in e for x in ("<|end|>", "<|start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_paths_and_ranks(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9),
        (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.9), (1, 6, 99, "user", "lost parent", 0.0),
        (2, 1, 2, "user", "cycle", 0.0), (2, 2, 1, "user", "cycle", 0.0), (2, 3, 2, "user", "below a cycle", 0.0),
        (None, 1, None, None, None, None),
    ]
    messages = spark.createDataFrame(rows, MESSAGES)
    out = {(r["tree"], r["leaf"]): r for r in chat.format_conversations(messages).collect()}
    assert set(out) == {(1, 2), (1, 5), (1, 6), (None, 1)}
    assert out[1, 5]["n_turns"] == 4
    assert "".join(s["text"] for s in out[1, 5]["segments"] if s["loss"]) == "goodend"
    assert "".join(s["text"] for s in out[1, 5]["segments"]) == out[1, 5]["formatted"]
    best = chat.format_conversations(messages, best=1).collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {(1, 5), (None, 1)}


def test_long_chain_and_empty_table(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 0.0) for i in range(300)]
    (out,) = chat.format_conversations(spark.createDataFrame(rows, MESSAGES)).collect()
    assert out["n_turns"] == 300
    assert "".join(s["text"] for s in out["segments"] if s["loss"]) == "".join(f"t{i}" for i in range(0, 300, 2))
    assert chat.format_conversations(spark.createDataFrame([], MESSAGES)).collect() == []


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in chat.op1_chat_formatting(spark, sf).collect()}
    turns: dict = {-1: [("user", chat.PROBE), ("assistant", chat.PROBE)]}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(turns)
    for k, held in turns.items():
        assert got[k]["n_turns"] == len(held)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in held).encode()).hexdigest()
        learnt = "".join(b for a, b in held if a == "assistant")
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_repeated_turns_and_null_order(spark):
    df = spark.createDataFrame([(1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    out = {r["tree"]: r["n_turns"] for r in chat.format_conversations(chat.linear_tree(df)).collect()}
    assert out == {1: 3, None: 1}


def test_query_takes_the_best_branch(spark):
    """With the query's own number of branches: the branch of the highest mean score, ties by leaf."""
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "poor", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "on", 0.2), (1, 5, 3, "user", "off", 0.6), (2, 1, None, "user", "x", 0.5), (2, 2, 1, "assistant", "a", 0.5), (2, 3, 1, "assistant", "b", 0.5)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {r["tree"]: (r["leaf"], [t["text"] for t in r["turns"]]) for r in chat.format_conversations(messages, chat.BRANCHES).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {1: (5, ["q", "good", "off"]), 2: (2, ["x", "a"])}
