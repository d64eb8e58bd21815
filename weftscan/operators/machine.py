"""A scanner engine: each language is a lexicon of openers, found by one search, and nested code by a stack of frames.

``Lexicon.events`` finds the next position where anything may begin, so plain code costs no Python step for each
character. A handler of the group that matched emits a segment, enters a literal with holes, or moves on. Holes
are frames on an explicit stack, however deep they nest. Every scanner is total: what does not end, ends with the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.plain import Stripped, strip_block, strip_comment, strip_delimited, strip_marker

Segment = tuple[int, int, str, "str | None", "list[int] | None", tuple[str, ...]]
CODE = ("code",)
#: In place of a slash's position: it stands before the literal that is being read.
CARRIED = -2
#: Line ends of multi-line anchors: four characters, not the line feed alone.
BREAKS = "\n\r\u2028\u2029"
LINE_START, LINE_END = f"(?<=[{BREAKS}])", rf"(?=[{BREAKS}]|\Z)"


@dataclass(slots=True)
class Code:
    """Code, of the file or of a hole; a hole ends at the brace that its own do not match."""

    hole: bool = False
    limit: int = -1
    depth: int = 0
    slash: int = -1

    def carry(self, text: str, at: int) -> None:
        """A literal begins at ``at``: a slash before it on its line still counts after it, whatever lines it spans."""
        if self.slash >= 0:
            self.slash = -1 if text.find("\n", self.slash, at) >= 0 else CARRIED


@dataclass(slots=True)
class Holed:
    """A literal with holes: where its current fragment began, and what is special in it."""

    special: re.Pattern
    tags: tuple[str, ...]
    start: int
    closer: str
    limit: int = -1
    after: int = -1


@dataclass(slots=True)
class Arguments:
    """The arguments of a call whose strings are not text: only comments count."""

    depth: int = 0


@dataclass(slots=True)
class Scan:
    text: str
    at: int = 0
    out: list[Segment] = field(default_factory=list)
    frames: list = field(default_factory=list)

    def emit(self, start: int, end: int, stripped: Stripped, tags: tuple[str, ...]) -> None:
        self.out.append((start, end, stripped[0], self.text[start:end], stripped[1], tags))
        self.at = end

    def fragment(self, start: int, end: int, tags: tuple[str, ...]) -> None:
        """Part of a literal between holes; empty ones are dropped, and there is no map."""
        if end > start:
            part = self.text[start:end]
            self.out.append((start, end, part, part, None, tags))


Handler = Callable[[Scan, re.Match, Code], None]


@dataclass(frozen=True)
class Lexicon:
    events: re.Pattern
    handlers: dict[str, Handler]


_QUOTED = {q: re.compile(rf"[^\\{q}]*+(?:\\.[^\\{q}]*+)*+\\?", re.S) for q in "\"'`"}


def quoted_end(text: str, body: int, quote: str) -> tuple[int, bool]:
    """(end, whether closed) of a literal with backslash escapes whose body begins at ``body``."""
    end = _QUOTED[quote].match(text, body).end()
    return (end + 1, True) if end < len(text) else (len(text), False)


def line_end(text: str, at: int) -> int:
    found = text.find("\n", at)
    return len(text) if found < 0 else found


def find_end(text: str, closer: str, at: int) -> tuple[int, bool]:
    found = text.find(closer, at)
    return (len(text), False) if found < 0 else (found + len(closer), True)


def line_comment(tags: tuple[str, ...], doc: tuple[str, ...] | None = None, bang: bool = False) -> Handler:
    """A comment from two slashes; with ``doc``, three of them (not four) or, with ``bang``, ``//!`` document."""

    def handle(scan: Scan, m: re.Match, frame: Code) -> None:
        text, start = scan.text, m.start()
        third, fourth = text[start + 2 : start + 3], text[start + 3 : start + 4]
        documents = doc is not None and ((third == "/" and fourth != "/") or (bang and third == "!"))
        end = line_end(text, start)
        scan.emit(start, end, strip_marker(text[start:end], 3 if documents else 2), doc if documents else tags)
        frame.slash = -1

    return handle


def hash_comment(tags: tuple[str, ...]) -> Handler:
    def handle(scan: Scan, m: re.Match, frame: Code) -> None:
        end = line_end(scan.text, m.start())
        scan.emit(m.start(), end, strip_marker(scan.text[m.start() : end], 1), tags)
        frame.slash = -1

    return handle


def block_comment(tags: tuple[str, ...], doc: tuple[str, ...], short_doc: bool = False) -> Handler:
    """A comment to the first closing marker; it documents if it opens with two stars and, unless ``short_doc``, is no ``/**/``."""

    def handle(scan: Scan, m: re.Match, frame: Code) -> None:
        end, _ = find_end(scan.text, "*/", m.start() + 2)
        raw = scan.text[m.start() : end]
        documents = raw.startswith("/**") and (short_doc or len(raw) >= 5)
        scan.emit(m.start(), end, strip_comment(raw), doc if documents else tags)
        frame.slash = -1

    return handle


_NEST = re.compile(r"/\*|\*/")


def nested_comment(tags: tuple[str, ...], doc: tuple[str, ...]) -> Handler:
    """A comment that holds comments; ``/*!`` documents too."""

    def handle(scan: Scan, m: re.Match, frame: Code) -> None:
        end, depth = m.start(), 0
        while True:
            found = _NEST.search(scan.text, end)
            if not found:
                end = len(scan.text)
                break
            end, depth = found.end(), depth + (1 if found[0] == "/*" else -1)
            if not depth:
                break
        raw = scan.text[m.start() : end]
        inner = raw.startswith("/*!")
        stripped = strip_block("/**" + raw[3:] if inner else raw)
        scan.emit(m.start(), end, stripped, doc if inner or (raw.startswith("/**") and len(raw) >= 5) else tags)

    return handle


def quoted(tags: dict[str, tuple[str, ...]]) -> Handler:
    """A literal with backslash escapes that a quote, the last character of the match, opens."""

    def handle(scan: Scan, m: re.Match, frame: Code) -> None:
        quote = m[0][-1]
        end, closed = quoted_end(scan.text, m.end(), quote)
        scan.emit(m.start(), end, strip_delimited(scan.text[m.start() : end], m.end() - m.start(), 1, closed), tags[quote])

    return handle


def skip_quoted(scan: Scan, m: re.Match, frame: Code) -> None:
    scan.at = quoted_end(scan.text, m.end(), m[0][-1])[0]


def delimited(closer: Callable[[re.Match], str], tags: Callable[[re.Match], tuple[str, ...]]) -> Handler:
    """A literal without escapes that ends at the first closer."""

    def handle(scan: Scan, m: re.Match, frame: Code) -> None:
        stop = closer(m)
        end, closed = find_end(scan.text, stop, m.end())
        scan.emit(m.start(), end, strip_delimited(scan.text[m.start() : end], m.end() - m.start(), len(stop), closed), tags(m))

    return handle


def open_brace(scan: Scan, m: re.Match, frame: Code) -> None:
    frame.depth += 1
    scan.at = m.end()


def close_brace(scan: Scan, m: re.Match, frame: Code) -> None:
    scan.at = m.end()
    if frame.hole and not frame.depth:
        scan.frames.pop()
    else:
        frame.depth -= 1


BRACES = {"open": open_brace, "close": close_brace}
BRACE_EVENTS = r"(?P<open>\{)|(?P<close>\})"


def enter(scan: Scan, special: re.Pattern, tags: tuple[str, ...], body: int, closer: str, limit: int = -1, after: int = -1) -> None:
    """Enter a literal with holes."""
    scan.at = body
    scan.frames.append(Holed(special, tags, body, closer, limit, after))


def _in_literal(scan: Scan, top: Holed) -> None:
    limit = top.limit if top.limit >= 0 else len(scan.text)
    while scan.at < limit:
        m = top.special.search(scan.text, scan.at)
        if not m or m.start() >= limit:
            break
        kind = m.lastgroup
        scan.at = m.end()
        if kind == "hole":
            scan.fragment(top.start, m.start(), top.tags)
            scan.frames.append(Code(hole=True, limit=top.limit))
            return
        if kind == "end":
            scan.fragment(top.start, m.start(), top.tags)
            scan.frames.pop()
            return
    scan.fragment(top.start, limit, top.tags)
    scan.at = top.after if top.after >= 0 else limit
    scan.frames.pop()


_IN_ARGUMENTS = re.compile(r"(?P<open>\()|(?P<close>\))|(?P<line>//)|(?P<block>/\*)|(?P<quote>[\"'])")


def _in_arguments(scan: Scan, top: Arguments, handlers: dict[str, Handler]) -> None:
    quiet = Code()
    while m := _IN_ARGUMENTS.search(scan.text, scan.at):
        scan.at = m.end()
        if m.lastgroup == "open":
            top.depth += 1
        elif m.lastgroup == "close":
            if not top.depth:
                scan.frames.pop()
                return
            top.depth -= 1
        elif m.lastgroup == "quote":
            skip_quoted(scan, m, quiet)
        else:
            handlers[m.lastgroup](scan, m, quiet)
    scan.at = len(scan.text)
    scan.frames.pop()


def segments(lexicon: Lexicon, text: str) -> list[Segment]:
    """Tagged segments in the order of emission, without the gaps between them."""
    scan = Scan(text)
    scan.frames.append(Code())
    while scan.frames:
        top = scan.frames[-1]
        if isinstance(top, Holed):
            if top.start < 0:  # back from a hole
                top.start = scan.at
            _in_literal(scan, top)
            if scan.frames and scan.frames[-1] is not top and isinstance(scan.frames[-1], Code) and scan.frames[-1].hole:
                top.start = -1
            continue
        if isinstance(top, Arguments):
            _in_arguments(scan, top, lexicon.handlers)
            continue
        limit = top.limit if top.limit >= 0 else len(text)
        while scan.frames and scan.frames[-1] is top:
            if top.slash == CARRIED:
                top.slash = scan.at
            m = lexicon.events.search(text, scan.at) if scan.at < limit else None
            if not m or m.start() >= limit:
                scan.at = max(scan.at, limit)
                scan.frames.pop()
                break
            scan.at = m.start()
            lexicon.handlers[m.lastgroup](scan, m, top)
            if scan.at == m.start() and scan.frames and scan.frames[-1] is top:
                scan.at += 1  # nothing began here after all
    return scan.out


def fill_gaps(found: list[Segment], text: str, raw: bool = False) -> list[Segment]:
    """The segments and, tagged as code, what lies between them; the end of the last one decides, whatever came before."""
    out: list[Segment] = []
    at = 0
    for s in found:
        if s[0] > at:
            gap = text[at : s[0]]
            out.append((at, s[0], gap, gap if raw else None, None, CODE))
        at = s[1]
        out.append(s)
    if at < len(text):
        gap = text[at:]
        out.append((at, len(text), gap, gap if raw else None, None, CODE))
    return out


@lru_cache(maxsize=256)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.S)
