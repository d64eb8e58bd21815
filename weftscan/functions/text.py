"""Text normalisation with offset maps, as columns: all of it runs in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plain import ENTITIES

_INTS = "array<int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: expressions inside lambdas are not shared by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ints(*values: Column | int) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]).cast(_INTS)


def _struct(text: Column, spans: Column) -> Column:
    return F.struct(text.alias("text"), spans.cast(_INTS).alias("map"))


def strip_marker(raw: Column, marker: Column | int) -> Column:
    """struct(text, map) without ``marker`` characters and one blank after them."""
    marker = F.lit(marker) if isinstance(marker, int) else marker
    skip = marker + F.when(raw.substr(marker + 1, F.lit(1)) == " ", 1).otherwise(0)
    return _struct(raw.substr(skip + 1, F.length(raw)), _ints(skip, 0))


def strip_delimited(raw: Column, opening: Column | int, closing: Column | int, closed: Column) -> Column:
    """struct(text, map) without delimiters; the closing one only where ``closed``."""
    opening = F.lit(opening) if isinstance(opening, int) else opening
    closing = F.lit(closing) if isinstance(closing, int) else closing
    text = raw.substr(opening + 1, F.length(raw) - opening - F.when(closed, closing).otherwise(0))
    n = F.length(text)
    empty = F.array().cast(_INTS)
    return _struct(text, F.concat(_ints(opening, 0), F.when(n > 0, _ints(n, n)).otherwise(empty), F.when(closed, _ints(closing, 0)).otherwise(empty)))


def gutter_length(line: Column) -> Column:
    """Characters of a continuation line's gutter: blanks, a star, one blank; 0 without a star."""
    return F.length(F.regexp_extract(line, r"^[ \t]*\* ?", 0))


def strip_block(raw: Column) -> Column:
    """struct(text, map) of a block comment without markers, gutters and padding."""
    first = F.when(raw.startswith("/**") & (F.length(raw) >= 5), 3).otherwise(2)
    opening = first + F.when(raw.substr(first + 1, F.lit(1)) == " ", 1).otherwise(0)
    none = F.array().cast(_INTS)

    def lines_of(head: Column) -> Column:
        """Of each line of the body: where its content begins, how long it is, whether a blank pads its end."""
        at, closed = head["at"], head["closed"]
        body = raw.substr(at + 1, F.length(raw) - at - F.when(closed, 2).otherwise(0))
        cut = lambda xs: F.transform(xs, lambda x, k: let(F.when(k == 0, 0).otherwise(gutter_length(x)), lambda g: measured(x, k, F.size(xs) - 1, g)))

        def measured(x: Column, k: Column, last: Column, gutter: Column) -> Column:
            pad = F.when(closed & (k == last) & (F.length(x) > gutter) & x.endswith(" "), 1).otherwise(0)
            end = F.when(closed & (k == last), 2 + pad).otherwise(-1)
            return F.struct(x.substr(gutter + 1, F.length(x) - gutter - pad).alias("x"), (k > 0).alias("later"), gutter.alias("g"), end.alias("end"))

        return let(F.split(body, "\n", -1), cut)

    def spans(v: Column) -> Column:
        n = F.length(v["x"])
        return F.concat(
            F.when(v["later"], _ints(1, 1)).otherwise(none), F.when(v["g"] > 0, _ints(v["g"], 0)).otherwise(none),
            F.when(n > 0, _ints(n, n)).otherwise(none), F.when(v["end"] > 0, _ints(v["end"], 0)).otherwise(none),
        )

    def stripped(head: Column) -> Column:
        return let(lines_of(head), lambda vs: _struct(F.array_join(F.transform(vs, lambda v: v["x"]), "\n"), F.concat(_ints(head["at"], 0), F.flatten(F.transform(vs, spans)))))

    head = let(opening, lambda at: F.struct(at.alias("at"), ((F.length(raw) - at >= 2) & raw.endswith("*/")).alias("closed")))
    return let(head, stripped)


def strip_comment(raw: Column) -> Column:
    """struct(text, map) of a line or block comment."""
    return F.when(raw.startswith("//"), strip_marker(raw, 2)).otherwise(strip_block(raw))


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def decode_escape(raw: Column) -> Column:
    """The characters that a JavaScript escape sequence stands for. Surrogates become U+FFFD."""
    c = raw.substr(2, 1)
    rest = raw.substr(F.lit(2), F.length(raw))
    hex2 = F.regexp_extract(raw, r"^\\x([0-9a-fA-F]{2})$", 1)
    digits = F.regexp_extract(raw, r"^\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]+))$", 1)
    digits = F.when(digits != "", digits).otherwise(F.regexp_extract(raw, r"^\\u([0-9a-fA-F]+)$", 1))
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    code = F.when(F.length(short) <= 6, F.conv(short, 16, 10).cast("long"))
    one = F.when(code.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(character(code))
    simple = [("n", "\n"), ("t", "\t"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("v", "\v"), ("\n", ""), ("\r", ""), ("\u2028", ""), ("\u2029", "")]
    out = F.when(c.isin("\\", "'", '"', "`", "$"), c)
    for letter, value in simple:
        out = out.when(c == letter, F.lit(value))
    out = out.when((c == "0") & (F.length(raw) == 2), F.lit("\0"))
    out = out.when(hex2 != "", character(F.conv(hex2, 16, 10)))
    return out.when((digits != "") & (code <= 0x10FFFF), one).otherwise(rest)


def _entities() -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in ENTITIES]), F.array(*[F.lit(v) for v in ENTITIES.values()]))


def decode_reference(raw: Column) -> Column:
    """The character of an HTML reference; anything else stays as it is."""
    decimal = F.regexp_extract(raw, r"^&#([0-9]+);$", 1)
    hexa = F.regexp_extract(raw, r"^&#x([0-9a-fA-F]+);$", 1)
    name = F.regexp_extract(raw, r"^&(\w+);$", 1)
    trim = lambda d: F.regexp_replace(d, "^0+(?=.)", "")
    code = F.when((decimal != "") & (F.length(trim(decimal)) <= 7), decimal.cast("long")).when((hexa != "") & (F.length(trim(hexa)) <= 6), F.conv(trim(hexa), 16, 10).cast("long"))
    named = F.when(name != "", F.try_element_at(_entities(), name))
    return F.coalesce(F.when(code <= 0x10FFFF, character(code)), named, raw)


def decode_parts(parts: Column, special: str = "is_escape", decode=decode_escape) -> Column:
    """struct(text, map) of array<struct<text, special>>: special parts decoded, all joined."""
    decoded = F.transform(parts, lambda p: F.when(p[special], decode(p["text"])).otherwise(p["text"]))
    lengths = F.transform(F.arrays_zip(F.transform(parts, lambda p: p["text"]).alias("a"), decoded.alias("b")), lambda z: F.array(F.length(z["a"]), F.length(z["b"])))
    return _struct(F.array_join(decoded, ""), F.flatten(lengths))


def decode_html_text(text: Column) -> Column:
    """struct(text, map) of a run of markup text: references decoded, each run between them one span."""
    pieces = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]+|#x[0-9a-fA-F]+|\w+);|(?:[^&]|&(?!(?:#[0-9]+|#x[0-9a-fA-F]+|\w+);))++"), F.lit(0))
    parts = F.transform(pieces, lambda p: F.struct(p.alias("text"), p.rlike(r"^&(?:#[0-9]+|#x[0-9a-fA-F]+|\w+);$").alias("is_reference")))
    return decode_parts(parts, "is_reference", decode_reference)


def apply_map(raw: Column, spans: Column) -> Column:
    """The text that a map of copied and dropped spans leaves of ``raw``, with what follows the map copied."""
    kind = "struct<at:int,out:string>"
    pairs = F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda k: F.struct(F.get(spans, 2 * k).alias("s"), F.get(spans, 2 * k + 1).alias("d")))
    pairs = F.when(F.size(spans) >= 2, pairs).otherwise(F.array().cast("array<struct<s:int,d:int>>"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    step = lambda a, p: F.struct((a["at"] + p["s"]).alias("at"), F.concat(a["out"], F.when(p["d"] > 0, raw.substr(a["at"] + 1, p["s"])).otherwise("")).alias("out")).cast(kind)
    done = F.aggregate(pairs, start, step)
    return F.concat(done["out"], raw.substr(done["at"] + 1, F.length(raw)))


def source_offset(spans: Column, offset: Column) -> Column:
    """Where in the raw text the character at ``offset`` of the text begins; what follows the map is copied."""
    kind = "struct<src:int,dst:int,at:int>"
    pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.size(spans) / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.coalesce(F.get(spans, 2 * k), F.lit(0)).alias("s"), F.coalesce(F.get(spans, 2 * k + 1), F.lit(0)).alias("d")))

    def step(a: Column, p: Column) -> Column:
        inside = F.when(p["s"] == p["d"], a["src"] + offset - a["dst"]).otherwise(a["src"])
        at = F.when(a["at"].isNull() & (offset < a["dst"] + p["d"]), inside).otherwise(a["at"])
        return F.struct((a["src"] + p["s"]).alias("src"), (a["dst"] + p["d"]).alias("dst"), at.alias("at")).cast(kind)

    start = F.struct(F.lit(0).alias("src"), F.lit(0).alias("dst"), F.lit(None).cast("int").alias("at")).cast(kind)
    done = F.aggregate(pairs, start, step)
    return F.when(spans.isNull(), offset).otherwise(F.coalesce(done["at"], done["src"] + offset - done["dst"]))


def utf16_offset(content: Column, offset: Column) -> Column:
    """An offset in code points as UTF-16 code units: one more for every earlier character above U+FFFF."""
    before = content.substr(F.lit(1), offset)
    return offset + F.length(F.regexp_replace(before, "[\\x{0}-\\x{FFFF}]", ""))


def escape_regex(value: Column) -> Column:
    return F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def wrap_list(items: Column, width: int) -> Column:
    """Items joined by commas into lines of at most ``width`` characters, where possible; lines joined by <br>."""
    kind = "struct<done:string,line:string>"

    def add(a: Column, x: Column) -> Column:
        longer = F.concat(a["line"], F.lit(", "), x)
        full = F.length(longer) > width
        done = F.concat(a["done"], a["line"], F.lit("<br>"))
        grown = F.when(full, F.struct(done.alias("done"), x.alias("line")).cast(kind)).otherwise(F.struct(a["done"].alias("done"), longer.alias("line")).cast(kind))
        return F.when(a["line"] == "", F.struct(a["done"].alias("done"), x.alias("line")).cast(kind)).otherwise(grown)

    return F.aggregate(items, F.struct(F.lit("").alias("done"), F.lit("").alias("line")).cast(kind), add, lambda a: F.concat(a["done"], a["line"]))


def csv_field(value: Column) -> Column:
    """A field of comma-separated values, quoted if it holds a comma, a quote or a line end."""
    return F.when(value.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)
