import pytest
from pyspark.sql import functions as F

from weftscan.functions.tags import VOCABULARY, chain, defaults, tag_set
from weftscan.operators import filters

KNOWN = defaults("typescript")
LINE, BLOCK, DOC, SINGLE, CODE = chain("comment.line"), chain("comment.block"), chain("comment.block.doc"), chain("string.singleQuote"), chain("code")
MODULE = tag_set("string.singleQuote.module", "module.specifier.literal")
CASES = [
    ({}, LINE, True), ({}, CODE, False), ({}, ("strange",), True), ({"*": False}, LINE, False), ({"*": True}, CODE, True), ({"*": False}, ("strange",), False),
    ({"comment": False}, LINE, False), ({"comment": False}, SINGLE, True), ({"comment": False, "comment.line": True}, LINE, True), ({"comment": False, "comment.line": True}, BLOCK, False),
    ({"comment.block*": False}, DOC, False), ({"comment.block*": False, "comment.block.doc": True}, DOC, True), ({"*": False, "*.doc": True}, DOC, True), ({"*": False, "*.doc": True}, BLOCK, False),
    ({"*": False, "comment.*": True, "comment": False}, LINE, True), ({"*": False, "comment.*": True, "comment": False}, ("comment",), False),
    ({"string": True, "module": False}, MODULE, True), ({"module": False}, MODULE, False), ({"comment": None}, LINE, True), ({"code": True}, CODE, True), ({"c*ment": False}, LINE, False), ({"unknown": False}, LINE, True),
    ({"*.line": True, "comment": False}, LINE, False), ({"com*": False, "comment*": True}, LINE, True), ({"*": None}, CODE, False),
]


@pytest.mark.parametrize(("options", "tags", "kept"), CASES)
def test_rules(options, tags, kept):
    assert filters.keeps(options, KNOWN, tags) is kept


def test_the_column_decides_alike(spark):
    for options, tags, kept in CASES:
        row = spark.range(1).select(filters.predicate(options, KNOWN, F.array(*map(F.lit, tags))).alias("k"), filters.predicate(options, KNOWN, F.lit(None).cast("array<string>")).alias("n")).first()
        assert row.k is kept, (options, tags)
        assert row.n is filters.keeps(options, KNOWN, None)


def test_no_rules_and_all_on_filter_nothing():
    assert filters.keeps_everything(None, {"a": True}) and filters.keeps_everything({"a": None}, {"a": True})
    assert not filters.keeps_everything(None, KNOWN)


def test_vocabularies_are_whole():
    for family, tags in VOCABULARY.items():
        assert len(tags) == len(set(tags)) and "code" in tags
        assert all(set(chain(t)) <= set(tags) for t in tags), family
