"""Wikitext: nesting, policies, flags."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import wikitext as X

POLICY = X.Templates(discard=frozenset({"header", "gap"}), keep=frozenset({"sc", "c"}), gap=frozenset({"missing"}), initial=("initial",))


@pytest.mark.parametrize(
    ("raw", "text", "flags"),
    [
        ("{{Header|x=1}}Plain", "Plain", []),
        ("{{sc|t=2|ONE}} {{c|two|three}} {{Initial|[[File:S.jpg|50px|S]]}}o {{missing|word}}", "ONE three So word", ["transcription_gap_template"]),
        ("{{sc|a {{c|b {{sc|deep}}}} z}}", "a b deep z", []),
        ("{{Odd_One|x}}rest {{ }}", "rest", ["unresolved_template:empty", "unresolved_template:odd one"]),
        ("{{sc|[[A|label]]}} [[B]] [[File:x.png|thumb]][http://x.y name] [http://x.y]", "label B name", []),
        ("<gallery>a</gallery>b<math>c</math>{| t |}d<!-- e --><ref name=x/>f<ref>g</ref>", "bdf", ["removed_gallery_block", "removed_math_block", "removed_wikitable"]),
        ("== Head ==\n'''bold''' ''it''<br/>x &amp; y <blink>z</blink>", "Head\nbold it\nx & y z", ["unresolved_html_tag"]),
        ("open {{sc|never", "open {{sc|never", ["unresolved_template_markup"]),
        ("close }} only", "close }} only", ["unresolved_template_markup"]),
        ("{{§}} 4\r\n\r\n\r\n\r\nend �", "§ 4\n\nend �", ["replacement_character"]),
        ("", "", []),
    ],
)
def test_clean(raw, text, flags):
    assert X.clean(raw, POLICY) == (text, flags)


def test_noinclude_goes_from_pages_only():
    assert X.clean("a<noinclude>b</noinclude>", POLICY, page=True) == ("a", [])
    assert X.clean("a<noinclude>b</noinclude>", POLICY)[0] == "ab"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["{{", "}}", "[[", "]]", "|", "sc", "gap", "x", " ", "=", "\n", "{", "]"]), max_size=30).map("".join))
def test_any_text_ends(text):
    flags: set = set()
    out = X.expand(text, POLICY, flags)
    assert X.expand("a" + text.replace("{", "").replace("}", "") + "b", POLICY, set()) == "a" + text.replace("{", "").replace("}", "") + "b"
    assert len(out) <= len(text) and X.clean(text, POLICY) is not None


def test_deep_nesting_is_linear():
    assert X.clean("{{sc|" * 5_000 + "x" + "}}" * 5_000, POLICY) == ("x", [])


def test_column(spark):
    df = spark.createDataFrame([("{{sc|a}} b",), (None,)], "t string").select(X.plain_text(F.col("t"), POLICY).alias("p"))
    assert [(r["p"]["text"], r["p"]["flags"]) for r in df.collect()] == [("a b", []), ("", [])]
