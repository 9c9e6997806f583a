import pytest

#: Names that an operator may use for columns of its own on the way.
PRIVATE = ["_id", "_text", "_class", "_rank", "_card", "_tie", "_slice", "_before", "_rate", "_offset", "_hits", "_toxicity", "_copy", "_row", "_key", "_hash", "_bucket", "_at", "_found", "_spans"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, score double, fingerprint string, target double, kept boolean, position long, copies long, hits string, _extra map<string,string>, " + ", ".join(f"{c} int" for c in PRIVATE)


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), 7, 7, 7, 0.5, "x", 1.0, True, 7, 7, "x", {"k": "v"}, *[7] * len(PRIVATE))


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows, columns with the operators' own names."""
    words = " ".join(f"word{i % 97} stone river" for i in range(20_000))
    rows = [
        row(1, "the quick brown fox jumps over the lazy dog near the old river bank today"),
        row(2, "the quick brown fox jumps over the lazy dog near the old river bank today", "b"),
        row(2, "the quick brown fox jumps over the lazy dog near the old river bank today", "b"),
        row(3, None),
        row(4, ""),
        row(5, "   \n\t "),
        row(None, "a document without an id but with some words of its own"),
        row(None, None, None),
        row(6, "a" * 300_000),
        row(7, words, None),
        row(8, "7" * 50_000 + "." * 10 + "@" * 2_000 + "+" * 2_000 + " token=" * 3_000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
