"""Scanners of regular languages as one partition pattern: Go, Java, C and C++, and the comment-only example.

``regexp_extract_all`` cuts a text into literals, comments and runs of code whose concatenation is the text. Offsets
are running sums of lengths, taken block by block so that their cost stays linear in the number of pieces. All of
it is built-in functions over one row, so no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tags import chain
from ..functions.text import let, strip_comment, strip_delimited, strip_marker
from ..schema import SEGMENTS_DDL

_LINE, _BLOCK = r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)"
_DOUBLE, _SINGLE = (rf"{q}(?:[^{q}\\]++|\\(?s:.)|\\\z)*+(?:{q}|\z)" for q in ('"', "'"))
_RAW_START = r'(?<![A-Za-z0-9_])(?:u8|u|U|L)?R"[^(]{0,17}\('
_RUN = rf"(?:(?!{_RAW_START})[A-Za-z0-9_.])"
_NUMBER = rf"(?<![A-Za-z0-9_.])(?:[0-9]|\.[0-9]){_RUN}*+(?:'(?=[A-Za-z0-9_]){_RUN}*+)*+"
#: Patterns of the pieces, in order of precedence; the last takes all code up to where another piece may begin.
PARTITIONS = {
    "example": "|".join([_LINE, _BLOCK, r"(?:[^/\"'`]++|/(?![/*])|" + "|".join(rf"{q}(?:[^{q}\\]++|\\(?s:.)|\\\z)*+(?:{q}|\z)" for q in "\"'`") + ")++"]),
    "go": "|".join([_LINE, _BLOCK, r"`[^`]*+(?:`|\z)", _DOUBLE, _SINGLE, r"(?:[^/`\"']++|/(?![/*]))++"]),
    "java": "|".join([_LINE, _BLOCK, r'"""(?:[^"\\]++|\\(?s:.)|\\\z|"(?!""))*+(?:"""|\z)', _DOUBLE, _SINGLE, r"(?:[^/\"']++|/(?![/*]))++"]),
    "c-cpp": "|".join([
        _LINE, _BLOCK, r'(?<![A-Za-z0-9_])(?:u8|u|U|L)?R"([^(]{0,17})\((?s:.*?)(?:\)\1"|\z)', _DOUBLE,
        rf"(?:{_NUMBER}|(?!{_RAW_START})(?!/[/*])[^\"'])++", _SINGLE,
    ]),
}
FAMILIES = list(PARTITIONS)
#: Pieces whose lengths are summed together; the sums of blocks are summed in turn.
BLOCK = 256


def pieces(content: Column, family: str) -> Column:
    """The pieces of a text, whose concatenation is the text."""
    return F.regexp_extract_all(content, F.lit(PARTITIONS[family]), F.lit(0))


def starts(lengths: Column) -> Column:
    """Exclusive running sums of an array of lengths."""
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    running = lambda xs, base: F.slice(F.aggregate(xs, F.array(base), grow), 1, F.size(xs))
    short = lambda xs: running(xs, F.lit(0))

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(running(sums, F.lit(0)), lambda bases: F.flatten(F.transform(blocks, lambda b, k: running(b, F.get(bases, k)))))

    def cut(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(xs) <= BLOCK, short(xs)).otherwise(let(blocks, summed))

    return let(lengths, cut)


def _tags(leaf: str) -> Column:
    return F.array(*[F.lit(t) for t in chain(leaf)])


def _classified(piece: Column, family: str) -> Column:
    """struct(text, map, tags) of a piece; the text of code is null, as is its map."""
    tagged = lambda s, leaf: let(s, lambda v: F.struct(v["text"].alias("text"), v["map"].alias("map"), _tags(leaf).alias("tags")))
    doc = piece.startswith("/**") if family == "example" else piece.startswith("/**") & (F.length(piece) >= 5)
    out = F
    if family == "c-cpp":
        documents = piece.rlike("^//(?:/(?!/)|!)")
        out = out.when(documents, tagged(strip_marker(piece, 3), "comment.line.doc"))
    out = out.when(piece.startswith("//"), tagged(strip_marker(piece, 2), "comment.line"))
    out = out.when(piece.startswith("/*") & doc, tagged(strip_comment(piece), "comment.block.doc"))
    out = out.when(piece.startswith("/*"), tagged(strip_comment(piece), "comment.block"))
    # a literal of one character is open, and so is one whose last quote an odd run of backslashes takes
    closed = lambda q: piece.rlike(rf"(?s)^{q}(?:[^{q}\\]|\\.)*+{q}$") & piece.endswith(q)
    if family == "go":
        raw_closed = (F.length(piece) >= 2) & piece.endswith("`")
        out = out.when(piece.startswith("`"), tagged(strip_delimited(piece, 1, 1, raw_closed), "string.raw"))
    if family == "java":
        block_closed = piece.rlike(r'(?s)^"""(?:[^"\\]|\\.|"(?!""))*+"""$') & piece.endswith('"""')
        out = out.when(piece.startswith('"""'), tagged(strip_delimited(piece, 3, 3, block_closed), "string.textBlock"))
    if family == "c-cpp":
        raw = r'^(?:u8|u|U|L)?R"([^(]{0,17})\('
        mark = F.regexp_extract(piece, raw, 1)
        opening = F.length(F.regexp_extract(piece, raw, 0))
        closer = F.concat(F.lit(")"), mark, F.lit('"'))
        raw_closed = (F.length(piece) >= opening + F.length(closer)) & piece.endswith(closer)
        out = out.when(piece.rlike(raw), tagged(strip_delimited(piece, opening, F.length(closer), raw_closed), "string.raw"))
    if family != "example":
        out = out.when(piece.startswith('"'), tagged(strip_delimited(piece, 1, 1, closed('"')), "string.doubleQuote"))
        out = out.when(piece.startswith("'"), tagged(strip_delimited(piece, 1, 1, closed("'")), "string.singleQuote"))
    code = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("map"), _tags("code").alias("tags"))
    return out.otherwise(code)


def scan(content: Column, family: str) -> Column:
    """array<segment> of a text, gaps included as code; a null text gives null, an empty one no segments."""

    def segment(z: Column, k: Column) -> Column:
        return let(_classified(z["p"], family), lambda c: F.struct(
            k.cast("int").alias("pos"), z["s"].alias("start"), (z["s"] + F.length(z["p"])).alias("end"), F.coalesce(c["text"], z["p"]).alias("text"),
            F.when(c["text"].isNotNull(), z["p"]).alias("raw_text"), c["map"].alias("map"), c["tags"].alias("tags"),
        ))

    def placed(found: Column) -> Column:
        return F.transform(F.arrays_zip(found.alias("p"), starts(F.transform(found, F.length)).alias("s")), segment)

    return let(pieces(content, family), placed).cast(SEGMENTS_DDL)
