import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftscan.functions import plain, text

COMMENTS = [
    ("// one line", "one line", [3, 0]),
    ("//none", "none", [2, 0]),
    ("/* text */", "text", [3, 0, 4, 4, 3, 0]),
    ("/** hi */", "hi", [4, 0, 2, 2, 3, 0]),
    ("/**/", "", [2, 0, 2, 0]),
    ("/***/", "", [3, 0, 2, 0]),
    ("/* never closed", "never closed", [3, 0, 12, 12]),
    ("/**\n * one\n * two\n */", "\none\ntwo\n", [3, 0, 1, 1, 3, 0, 3, 3, 1, 1, 3, 0, 3, 3, 1, 1, 3, 0]),
    ("/*\n\tplain\n*/", "\n\tplain\n", None),
    ("/* *", "*", None),
]


@pytest.mark.parametrize(("raw", "expected", "spans"), COMMENTS)
def test_comments_lose_their_markers(raw, expected, spans):
    found, got = plain.strip_comment(raw)
    assert found == expected
    assert spans is None or got == spans
    assert plain.apply_map(raw, got) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="/* \n\tab", max_size=30), st.booleans())
def test_maps_replay_to_the_text(body, closed):
    raw = "/*" + body.replace("*/", "") + ("*/" if closed else "")
    found, spans = plain.strip_comment(raw)
    assert plain.apply_map(raw, spans) == found
    assert sum(spans[::2]) == len(raw)


def test_columns_agree_with_plain_functions(spark):
    raws = [r for r, _, _ in COMMENTS] + ["/* a\n  * b  */", "/** x\r\n *y */", "/*a*/ ", "// \U0001f600"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", text.strip_comment(F.col("raw")).alias("s")).collect()
    for r in rows:
        assert (r.s.text, r.s.map) == plain.strip_comment(r.raw), r.raw
    replayed = spark.createDataFrame([(r,) for r in raws], "raw string").withColumn("s", text.strip_comment(F.col("raw")))
    for r in replayed.select("s", text.apply_map(F.col("raw"), F.col("s.map")).alias("t")).collect():
        assert r.t == r.s.text


ESCAPES = {"\\n": "\n", "\\0": "\0", "\\012": "012", "\\x41": "A", "\\xZZ": "xZZ", "\\u00e9": "é", "\\u{1F600}": "\U0001f600", "\\u{110000}": "u{110000}", "\\q": "q", "\\\n": "", "\\\\": "\\", "\\`": "`", "\\$": "$", "\\1": "1", "\\u12": "\x12"}


def test_escapes(spark):
    for raw, expected in ESCAPES.items():
        assert plain.decode_escape(raw) == expected
    rows = spark.createDataFrame([(r,) for r in ESCAPES], "raw string").select("raw", text.decode_escape(F.col("raw")).alias("d")).collect()
    assert {r.raw: r.d for r in rows} == ESCAPES


def test_surrogate_pairs_join_and_lone_ones_are_replaced():
    assert plain.decode_parts([("\\uD83D", True), ("\\uDE00", True)])[0] == "\U0001f600"
    assert plain.decode_parts([("a", False), ("\\uD83D", True)])[0] == "a�"
    assert plain.decode_parts([]) == ("", [])


REFERENCES = {"&amp;": "&", "&eacute;": "é", "&apos;": "'", "&#239;": "ï", "&#x2014;": "—", "&bogus;": "&bogus;", "&Eacute;": "É", "&EACUTE;": "&EACUTE;", "&#x110000;": "&#x110000;", "&#9999999999;": "&#9999999999;", "&amp": "&amp", "&#X41;": "&#X41;", "&lang;": "〈"}


def test_references(spark):
    for raw, expected in REFERENCES.items():
        assert plain.decode_reference(raw) == expected
    rows = spark.createDataFrame([(r,) for r in REFERENCES], "raw string").select("raw", text.decode_reference(F.col("raw")).alias("d")).collect()
    assert {r.raw: r.d for r in rows} == REFERENCES
    assert len(plain.ENTITIES) == 253


def test_markup_text_keeps_a_pair_for_each_part(spark):
    raw = "Caf&eacute; na&#239;ve &#x2014; &amp; &bogus; text"
    r = spark.createDataFrame([(raw,)], "raw string").select(text.decode_html_text(F.col("raw")).alias("s")).first()
    assert r.s.text == "Café naïve — & &bogus; text"
    assert r.s.map == [3, 3, 8, 1, 3, 3, 6, 1, 3, 3, 8, 1, 1, 1, 5, 1, 1, 1, 7, 7, 5, 5]


def test_source_offsets_follow_the_map(spark):
    raw = "/* a\n * bc */"
    df = spark.createDataFrame([(raw,)], "raw string").withColumn("s", text.strip_comment(F.col("raw")))
    found = df.select(*[text.source_offset(F.col("s.map"), F.lit(k)).alias(f"o{k}") for k in range(4)]).first()
    assert [raw[o] for o in found] == list("a\nbc")


def test_wrapping_and_quoting(spark):
    df = spark.createDataFrame([(["aaa", "bbb", "cc"], 'a"b'), ([], "x\ny"), (["toolong"], "plain")], "items array<string>, v string")
    rows = df.select(text.wrap_list(F.col("items"), 8).alias("w"), text.csv_field(F.col("v")).alias("c"), text.utf16_offset(F.lit("\U0001f600x"), F.lit(2)).alias("u")).collect()
    assert [r.w for r in rows] == ["aaa, bbb<br>cc", "", "toolong"]
    assert [r.c for r in rows] == ['"a""b"', '"x\ny"', "plain"]
    assert rows[0].u == 3
