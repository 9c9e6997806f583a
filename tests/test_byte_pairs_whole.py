"""Byte pairs are trained on every pretoken."""

import inspect
import random
import re
from collections import Counter

from tessera.operators import tokens


def test_training_equals_the_plain_one(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aaabbcdé\U0001f600\U000f0000 \n=") for _ in range(60)) for _ in range(40)] + ["=" * 50, "abab abab", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = Counter(p for t in texts for p in re.findall(r"\S+|\s+", t or ""))
    for size in (13, 40, 70):
        got, want = tokens.train_byte_pairs(df, "text", size, ("<|end|>",)), tokens.BytePairs.train(sorted(counted.items()), size, ("<|end|>",))
        assert (got.merges, got.vocabulary) == (want.merges, want.vocabulary)


def test_no_pretoken_is_dropped(spark):
    """A character that only one rare pretoken behind 500,000 others holds is in the alphabet."""
    assert "most" not in inspect.signature(tokens.train_byte_pairs).parameters
    many = spark.range(500_000).selectExpr("concat(id, ' ', id) as text").unionAll(spark.createDataFrame([("~ž",)], "text string"))
    assert {"~", "ž"} <= set(tokens.train_byte_pairs(many, "text", 15).vocabulary)
