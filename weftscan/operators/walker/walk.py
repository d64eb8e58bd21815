"""From what the parser recorded to segments: which names and literals are the author's own, and their normal form."""

from __future__ import annotations

import re
import sys

from ...functions.plain import decode_parts, decode_reference, strip_comment
from ...functions.tags import chain, tag_set
from ..machine import Segment, fill_gaps
from .parser import Parser
from .reader import ESCAPE, REFERENCE

#: typed, markup of each grammar.
GRAMMARS = {"javascript": (False, True), "typescript": (True, False), "tsx": (True, True)}
#: Frames of Python that a level of nesting takes at most; a level takes a character at least.
FRAMES = 24
_QUOTES = {"'": "string.singleQuote", '"': "string.doubleQuote"}
_BLANK = re.compile(r"[\s\ufeff]*\Z")


def _parts(text: str, special: re.Pattern) -> list[tuple[str, bool]]:
    """A literal's text as runs and, between them, what ``special`` matches."""
    out, at = [], 0
    for m in special.finditer(text):
        if m.start() > at:
            out.append((text[at : m.start()], False))
        out.append((m[0], True))
        at = m.end()
    if at < len(text):
        out.append((text[at:], False))
    return out


def _string(text: str, start: int, end: int, module: bool, plain: bool) -> Segment | None:
    raw = text[start:end]
    if module and raw[1:2] not in (".", "/"):
        return None  # a bare specifier names a package, and is not the author's
    parts = _parts(raw[1:-1], REFERENCE if plain else ESCAPE)
    decoded, spans = decode_parts(parts, str) if plain else decode_parts(parts)
    quote = _QUOTES[raw[0]]
    tags = tag_set(f"{quote}.module", "module.specifier.literal") if module else chain(quote)
    return start, end, decoded, raw, [1, 0, *spans, 1, 0], tags


def segments(grammar: str, text: str) -> list[Segment]:
    """All segments of a text, gaps included."""
    typed, markup = GRAMMARS[grammar]
    # no nesting ends the reading: frames of Python functions are on the heap, and are taken only as they are needed
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000 + FRAMES * len(text)))
    parser = Parser(text, typed, markup)
    parser.program()
    out: list[Segment] = []
    hides = lambda scope, name: name in parser.local and scope.hides(name)
    for e in parser.events:
        if e[0] == "name":
            _, start, end, kind, scope, root, own = e
            name = text[start:end]
            if not own and kind in ("variable", "type") and name in parser.external and not hides(scope, name):
                continue
            if root is not None and root[0] in parser.local and not hides(root[1], root[0]):
                continue
            out.append((start, end, name, None, None, chain(f"identifier.{kind}")))
        elif e[0] == "string":
            if found := _string(text, *e[1:]):
                out.append(found)
        elif e[0] == "template":
            raw = text[e[1] : e[2]]
            decoded, spans = decode_parts(_parts(raw, ESCAPE))
            out.append((e[1], e[2], decoded, raw, spans, chain("string.templateLiteral")))
        else:
            raw = text[e[1] : e[2]]
            decoded, spans = decode_parts(_parts(raw, REFERENCE), decode_reference)
            if not _BLANK.match(decoded):
                out.append((e[1], e[2], decoded, raw, spans, chain("jsx.text")))
    covered = [(s[0], s[1]) for s in sorted(out) if s[3] is not None]
    at = 0
    for start, end in sorted(parser.r.comments.items()):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at < len(covered) and covered[at][0] <= start:
            continue  # within a literal that an abandoned reading took for code
        raw = text[start:end]
        stripped, spans = strip_comment(raw)
        leaf = "comment.line" if raw.startswith("//") else "comment.block.doc" if raw.startswith("/**") else "comment.block"
        out.append((start, end, stripped, raw, spans, chain(leaf)))
    ordered: list[Segment] = []
    for s in sorted(out, key=lambda s: (s[0], s[1])):
        if not ordered or s[0] >= ordered[-1][1]:
            ordered.append(s)
    return fill_gaps(ordered, text)
