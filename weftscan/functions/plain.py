"""Text normalisation with offset maps, for one string at a time; state machines in Python workers use these.

A map is a flat list of (source length, result length) pairs from the raw text to the text. Lengths are code points.
"""

from __future__ import annotations

import re
from html.entities import codepoint2name

_GUTTER = re.compile(r"[ \t]*\*( ?)")
_HEX2, _HEX = re.compile(r"[0-9a-fA-F]{2}\Z"), re.compile(r"[0-9a-fA-F]+\Z")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "\n": "", "\r": "", "\u2028": "", "\u2029": ""} | {c: c for c in "\\'\"`$"}
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#x([0-9a-fA-F]+)|([A-Za-z0-9_]+));\Z")
#: The 252 entities of XHTML 1.0 and the apostrophe; two of the standard library's names had other code points there.
ENTITIES = {name: chr(code) for code, name in codepoint2name.items()} | {"apos": "'"}
_SURROGATES = re.compile("[\ud800-\udbff][\udc00-\udfff]")

Stripped = tuple[str, list[int]]


def strip_marker(raw: str, marker: int) -> Stripped:
    """Without the first ``marker`` characters and one blank after them."""
    skip = marker + raw.startswith(" ", marker)
    return raw[skip:], [skip, 0]


def strip_delimited(raw: str, opening: int, closing: int, closed: bool) -> Stripped:
    """Without its delimiters; an unclosed literal has no closing one."""
    text = raw[opening : len(raw) - closing] if closed else raw[opening:]
    return text, [opening, 0] + ([len(text)] * 2 if text else []) + ([closing, 0] if closed else [])


def strip_block(raw: str) -> Stripped:
    """A block comment without markers, line gutters and the blanks that pad the markers."""
    opening = 3 if len(raw) >= 5 and raw.startswith("/**") else 2
    opening += raw.startswith(" ", opening)
    closed = len(raw) - opening >= 2 and raw.endswith("*/")
    body = raw[opening : len(raw) - 2 * closed]
    texts: list[str] = []
    spans = [opening, 0]
    lines = body.split("\n")
    for k, line in enumerate(lines):
        if k:
            spans += [1, 1]
            if (m := _GUTTER.match(line)) is not None:
                spans += [m.end(), 0]
                line = line[m.end() :]
        pad = closed and k == len(lines) - 1 and line.endswith(" ")
        if pad:
            line = line[:-1]
        if line:
            spans += [len(line)] * 2
        texts.append(line)
        if closed and k == len(lines) - 1:
            spans += [2 + pad, 0]
    return "\n".join(texts), spans


def strip_comment(raw: str) -> Stripped:
    return strip_marker(raw, 2) if raw.startswith("//") else strip_block(raw)


def decode_escape(raw: str) -> str:
    """The characters that an escape sequence of JavaScript stands for; an unknown one loses its backslash only."""
    c = raw[1:2]
    if c in _SIMPLE:
        return _SIMPLE[c]
    if c == "0" and len(raw) == 2:
        return "\0"
    code = None
    if c == "x" and _HEX2.match(raw, 2):
        code = int(raw[2:], 16)
    elif c == "u":
        digits = raw[3:-1] if raw[2:3] == "{" else raw[2:]
        if _HEX.match(digits):
            code = int(digits, 16)
    return raw[1:] if code is None or code > 0x10FFFF else chr(code)


def whole(text: str) -> str:
    """Surrogate pairs joined; a lone surrogate, which no UTF-8 column can hold, becomes U+FFFD."""
    joined = _SURROGATES.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), text)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in joined) else joined


def decode_parts(parts: list[tuple[str, bool]], decode=decode_escape) -> Stripped:
    """Parts (text, whether it is an escape) joined, with the pair of lengths of each."""
    texts = [decode(t) if special else t for t, special in parts]
    return whole("".join(texts)), [n for (t, _), d in zip(parts, texts, strict=True) for n in (len(t), len(d))]


def decode_reference(raw: str) -> str:
    """The character of an HTML reference; what is none, or unknown, or out of range stays as it is."""
    m = _REFERENCE.match(raw)
    if not m:
        return raw
    if m[3]:
        return ENTITIES.get(m[3], raw)
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if code <= 0x10FFFF else raw


def apply_map(raw: str, spans: list[int]) -> str | None:
    """The text that a map of copied and dropped spans leaves of ``raw``; None where the map replaces characters."""
    out, at = [], 0
    for src, dst in zip(spans[::2], spans[1::2], strict=True):
        if dst and dst != src:
            return None
        if dst:
            out.append(raw[at : at + src])
        at += src
    return "".join(out) + raw[at:]
