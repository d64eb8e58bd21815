"""The lexicons of the scanners: what may begin where, in order of precedence."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.plain import strip_delimited, strip_marker
from ..functions.tags import chain, tag_set
from .machine import (
    BRACE_EVENTS, BRACES, BREAKS, LINE_END, LINE_START, Arguments, Code, Lexicon, Scan, Segment, block_comment, compiled, delimited, enter, fill_gaps,
    hash_comment, line_comment, line_end, nested_comment, quoted, quoted_end, segments, skip_quoted,
)

LINE, LINE_DOC, BLOCK, BLOCK_DOC = chain("comment.line"), chain("comment.line.doc"), chain("comment.block"), chain("comment.block.doc")
QUOTES = {"'": chain("string.singleQuote"), '"': chain("string.doubleQuote")}
RAW = chain("string.raw")
SLASHES = r"(?P<line>//)|(?P<block>/\*)"
WORD, WORD_JS = "A-Za-z0-9_", "A-Za-z0-9_$"


def _lexicon(events: str, **handlers) -> Lexicon:
    return Lexicon(re.compile(events, re.S), handlers)


def _comments(doc: tuple[str, ...] | None = None, bang: bool = False) -> dict:
    return {"line": line_comment(LINE, doc, bang), "block": block_comment(BLOCK, BLOCK_DOC)}


EXAMPLE = _lexicon(SLASHES + "|(?P<quote>[\"'`])", line=line_comment(LINE), block=block_comment(BLOCK, BLOCK_DOC, short_doc=True), quote=skip_quoted)

GO = _lexicon(SLASHES + "|(?P<raw>`)|(?P<quote>[\"'])", **_comments(), raw=delimited(lambda m: "`", lambda m: RAW), quote=quoted(QUOTES))

_TEXT_BLOCK = re.compile(r'(?:[^"\\]|\\.|"(?!""))*+\\?', re.S)


def _text_block(scan: Scan, m: re.Match, frame: Code) -> None:
    end = _TEXT_BLOCK.match(scan.text, m.end()).end()
    closed = end < len(scan.text)
    end = end + 3 if closed else end
    scan.emit(m.start(), end, strip_delimited(scan.text[m.start() : end], 3, 3, closed), chain("string.textBlock"))


JAVA = _lexicon(SLASHES + "|(?P<triple>\"\"\")|(?P<quote>[\"'])", **_comments(), triple=_text_block, quote=quoted(QUOTES))

# -- C and C++ ---------------------------------------------------------------------------------------------------



class _Separators:
    """Whether a quote separates digits; it remembers the last one that does, so a long number stays linear."""

    def __init__(self) -> None:
        self.last = -1

    def __call__(self, text: str, at: int) -> bool:
        if not re.match(rf"[{WORD}]", text[at + 1 : at + 2]):
            return False
        start = at
        while start and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "_.")):
            start -= 1
        joined = start and text[start - 1] == "'" and start - 1 == self.last
        if joined or re.match(r"\.?[0-9]", text[start : start + 2]):
            self.last = at
            return True
        return False


def _c_lexicon() -> Lexicon:
    separates = _Separators()
    plain = quoted(QUOTES)

    def single(scan: Scan, m: re.Match, frame: Code) -> None:
        if not separates(scan.text, m.start()):
            plain(scan, m, frame)

    raw = delimited(lambda m: f'){m["mark"]}"', lambda m: RAW)
    events = SLASHES + rf"|(?P<raw>(?<![{WORD}])(?:u8|[uUL])?R\"(?P<mark>[^(]{{0,17}})\()|(?P<double>\")|(?P<single>')"
    # lastgroup names the group that closed last, and the outer one closes after the mark
    return _lexicon(events, **_comments(LINE_DOC, bang=True), raw=raw, double=plain, single=single)


# -- C# ----------------------------------------------------------------------------------------------------------

_VERBATIM_BODY = re.compile(r'[^"]*+(?:""[^"]*+)*+')
_IN_VERBATIM = re.compile(r'(?P<skip>""|\{\{|\}\})|(?P<end>")|(?P<hole>\{)')
_IN_INTERPOLATED = re.compile(r'(?P<skip>\\(?:.|\Z)|\{\{|\}\})|(?P<end>")|(?P<hole>\{)', re.S)


def _cs_raw(scan: Scan, start: int, body: int, run: int, tags: tuple[str, ...]) -> None:
    found = compiled('"{%d,}' % run).search(scan.text, body)
    end = found.start() + run if found else len(scan.text)
    scan.emit(start, end, strip_delimited(scan.text[start:end], body - start, run, found is not None), tags)


def _cs_prefixed(scan: Scan, m: re.Match, frame: Code) -> None:
    mark, run = m["mark"], len(m["run"])
    interpolated, verbatim = "$" in mark, "@" in mark
    if run >= 3:
        _cs_raw(scan, m.start(), m.end(), run, tag_set("string.raw", "string.interpolated") if interpolated else RAW)
    elif interpolated:
        tags = tag_set("string.verbatim", "string.interpolated") if verbatim else chain("string.interpolated")
        enter(scan, _IN_VERBATIM if verbatim else _IN_INTERPOLATED, tags, m.start() + len(mark) + 1, '"')
    else:
        body = m.start() + len(mark) + 1
        end = _VERBATIM_BODY.match(scan.text, body).end()
        closed = end < len(scan.text)
        end += closed
        scan.emit(m.start(), end, strip_delimited(scan.text[m.start() : end], len(mark) + 1, 1, closed), chain("string.verbatim"))


def _cs_triple(scan: Scan, m: re.Match, frame: Code) -> None:
    _cs_raw(scan, m.start(), m.end(), m.end() - m.start(), RAW)


CSHARP = _lexicon(
    BRACE_EVENTS + "|" + SLASHES + r"|(?P<prefixed>(?P<mark>@\$|\$@|@|\$)(?P<run>\"+))|(?P<triple>\"{3,})|(?P<quote>[\"'])",
    **BRACES, **_comments(LINE_DOC), prefixed=_cs_prefixed, triple=_cs_triple, quote=quoted(QUOTES), run=_cs_prefixed,
)

# -- Python ------------------------------------------------------------------------------------------------------

_PY_BODY = {q: re.compile(rf"(?:[^\\{q[0]}]|\\." + (rf"|{q[0]}(?!{q[:2]})" if len(q) > 1 else "") + r")*+\\?", re.S) for q in ("'", '"', "'''", '"""')}
_PY_IN = {q: re.compile(rf"(?P<skip>\\(?:.|\Z)|\{{\{{|\}}\}})|(?P<end>{q})|(?P<hole>\{{)", re.S) for q in _PY_BODY}


def _py_string(scan: Scan, m: re.Match, frame: Code) -> None:
    prefix, quote = (m["prefix"] or "").lower(), m["quote"]
    leaf = "string.tripleQuote" if len(quote) == 3 else "string.singleQuote" if quote == "'" else "string.doubleQuote"
    tags = tag_set(leaf, *["string.raw"] * ("r" in prefix), *["string.interpolated"] * ("f" in prefix))
    if "f" in prefix:
        enter(scan, _PY_IN[quote], tags, m.end(), quote)
        return
    end = _PY_BODY[quote].match(scan.text, m.end()).end()
    closed = end < len(scan.text)
    end += len(quote) * closed
    scan.emit(m.start(), end, strip_delimited(scan.text[m.start() : end], m.end() - m.start(), len(quote), closed), tags)


PYTHON = _lexicon(
    BRACE_EVENTS + rf"|(?P<hash>#)|(?P<string>(?P<prefix>(?<![{WORD}])(?:[rR][bBfF]|[bBfF][rR]|[rRuUfFbB]))?(?P<quote>'''|\"\"\"|['\"]))",
    **BRACES, hash=hash_comment(LINE), string=_py_string, quote=_py_string,
)

# -- Rust --------------------------------------------------------------------------------------------------------

_RUST_PREFIX = {"": "string", "b": "string.byte", "c": "string.c"}


def _rust_quoted(scan: Scan, m: re.Match, frame: Code) -> None:
    end, closed = quoted_end(scan.text, m.end(), '"')
    scan.emit(m.start(), end, strip_delimited(scan.text[m.start() : end], m.end() - m.start(), 1, closed), chain(_RUST_PREFIX[m[0][:-1]]))


def _skip(scan: Scan, m: re.Match, frame: Code) -> None:
    scan.at = m.end()


def _rust_raw_closer(m: re.Match) -> str:
    return '"' + m[0].count("#") * "#"


RUST = _lexicon(
    SLASHES + rf"|(?P<raw>(?<![{WORD}])[bc]?r#*\")|(?P<char>'(?:\"|\\\")'?)|(?P<quoted>(?:(?<![{WORD}])[bc])?\")",
    line=line_comment(LINE, LINE_DOC, bang=True), block=nested_comment(BLOCK, BLOCK_DOC), char=_skip, quoted=_rust_quoted,
    raw=delimited(_rust_raw_closer, lambda m: chain(_RUST_PREFIX[m[0][: m[0].index("r")]] + ".raw")),
)

# -- Ruby and TypeScript share two judgements --------------------------------------------------------------------

_REGEX = re.compile(r"/(?:[^\n\\\[/]++|\\.|\[(?:[^\n\\\]]++|\\.)*+\])*+/[A-Za-z]*+", re.S)


def _ended(text: str, at: int, blanks: str) -> int:
    """Where the text before ``at`` ends, its last blanks aside."""
    while at > 0:
        part = text[max(0, at - 32) : at]
        if kept := part.rstrip(blanks):
            return at - len(part) + len(kept)
        at -= len(part)
    return 0


#: A word at the end of what is looked at: longer ones than any keyword need not be whole.
_LAST_WORD = {extra: re.compile(rf"[A-Za-z0-9{extra}]*\Z") for extra in ("_", "_$")}


def _value_before(text: str, at: int, extra: str, ends: str, keywords: frozenset[str]) -> bool:
    """Whether a value ends just before ``at``, blanks aside: a closing mark, or a word that is no keyword."""
    end = _ended(text, at, " \t")
    tail = text[max(0, end - 24) : end]
    word = _LAST_WORD[extra].search(tail)[0]
    return bool(tail) and (tail[-1] in ends or bool(word) and word not in keywords)


def _guarded(scan: Scan, at: int, frame: Code, word: str) -> bool:
    """Whether a quote is no string: a bare slash came before on its line, and a name or a quote stands right before it."""
    if frame.slash < 0 or scan.text.find("\n", frame.slash, at) >= 0:
        return False
    before = scan.text[at - 1 : at]
    return bool(before) and ((before.isascii() and before.isalnum()) or before in word + "'\"")


# Words after which a slash, a percent sign or two angle brackets open a literal.
_RUBY_KEYWORDS = frozenset(
    "if unless while until case when and or not then else elsif begin do in return yield raise puts print match gsub sub scan split grep".split()
)
_RUBY_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_RUBY_IN = {q: re.compile(rf"(?P<skip>\\(?:.|\Z))|(?P<end>{q})|(?P<hole>#\{{)", re.S) for q in "\"`"}
_RUBY_IN_DOC = re.compile(r"(?P<skip>\\(?:.|\Z))|(?P<hole>#\{)", re.S)
_HEREDOC = re.compile(r"<<([~-]?)(?:(['\"])([A-Za-z_][A-Za-z0-9_]*)\2|([A-Za-z_][A-Za-z0-9_]*))")


def _ruby_operand(scan: Scan, at: int) -> bool:
    return _value_before(scan.text, at, "_", ")]}'\"", _RUBY_KEYWORDS)


def _ruby_begin(scan: Scan, m: re.Match, frame: Code) -> None:
    text, start = scan.text, m.start()
    body = min(len(text), line_end(text, start) + 1)
    found = compiled(rf"{LINE_START}=end[^{BREAKS}]*").search(text, body)
    end = found.end() if found else len(text)
    scan.emit(start, end, strip_delimited(text[start:end], body - start, found.end() - found.start() if found else 0, found is not None), BLOCK)
    frame.slash = -1


def _ruby_heredoc(scan: Scan, m: re.Match, frame: Code) -> None:
    text = scan.text
    if _ruby_operand(scan, m.start()) or not (head := _HEREDOC.match(text, m.start())):
        return
    body = min(len(text), line_end(text, head.end()) + 1)
    indent = r"[ \t]*" if head[1] else ""
    found = compiled(rf"{LINE_START}{indent}{head[3] or head[4]}[ \t]*{LINE_END}").search(text, body)
    stop, after = (found.start(), found.end()) if found else (len(text), len(text))
    frame.slash = -1
    tags = chain("string.heredoc")
    if head[2] == "'":
        scan.fragment(body, stop, tags)
        scan.at = after
    else:
        enter(scan, _RUBY_IN_DOC, tags, body, "", stop, after)


def _ruby_slash(scan: Scan, m: re.Match, frame: Code) -> None:
    found = None if _ruby_operand(scan, m.start()) else _REGEX.match(scan.text, m.start())
    frame.slash = -1 if found else m.start()
    if found:
        scan.at = found.end()


def _ruby_percent(scan: Scan, m: re.Match, frame: Code) -> None:
    text = scan.text
    head = re.compile(r"%([wWiIqQrsx]?)([(\[{<|!#/~^])").match(text, m.start())
    if not head or _ruby_operand(scan, m.start()):
        return
    opening, closing = head[2], _RUBY_CLOSERS.get(head[2], head[2])
    marks = compiled(r"\\(?:.|\Z)|" + "|".join(re.escape(x) for x in dict.fromkeys([closing, opening])))
    at, depth = head.end(), 1
    while depth and (found := marks.search(text, at)):
        at = found.end()
        if found[0] == closing:
            depth -= 1
        elif found[0] == opening:
            depth += 1
    if depth:
        at = len(text)
    elif head[1] == "r":
        at = re.compile("[A-Za-z]*").match(text, at).end()
    scan.at = at
    frame.slash = -1


def _ruby_char(scan: Scan, m: re.Match, frame: Code) -> None:
    if not _ruby_operand(scan, m.start()):
        scan.at = m.end()
        frame.slash = -1


_ruby_single = quoted(QUOTES)


def _ruby_quote(scan: Scan, m: re.Match, frame: Code) -> None:
    if m[0] != "`" and _guarded(scan, m.start(), frame, "_"):
        return
    frame.carry(scan.text, m.start())
    if m[0] == "'":
        _ruby_single(scan, m, frame)
    else:
        enter(scan, _RUBY_IN[m[0]], QUOTES['"'] if m[0] == '"' else chain("string.backtick"), m.end(), m[0])


RUBY = _lexicon(
    BRACE_EVENTS + r"|(?P<begin>(?:\A|(?<=\n))=begin)|(?P<hash>#)|(?P<heredoc><<)|(?P<slash>/)|(?P<percent>%)|(?P<char>\?['\"#])|(?P<quote>['\"`])",
    **BRACES, begin=_ruby_begin, hash=hash_comment(LINE), heredoc=_ruby_heredoc, slash=_ruby_slash, percent=_ruby_percent, char=_ruby_char, quote=_ruby_quote,
)

# Words after which a slash opens a pattern.
_JS_KEYWORDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_JS_TEMPLATE = re.compile(r"(?P<skip>\\(?:.|\Z))|(?P<end>`)|(?P<hole>\$\{)", re.S)
_MODULE = {q: tag_set(f"{t[-1]}.module", "module.specifier.literal") for q, t in QUOTES.items()}


_MODULE_WORD = re.compile(r"(?<![A-Za-z0-9_$])(?:(?P<either>import)|(?P<plain>from)|(?P<called>require))\Z")


def names_module(text: str, at: int) -> bool:
    """Whether a literal at ``at`` names a module: after ``from`` or ``import``, or the call of ``import`` or ``require``."""
    end = _ended(text, at, " \t\n")
    called = end > 0 and text[end - 1] == "("
    if called:
        end = _ended(text, end - 1, " \t\n")
    m = _MODULE_WORD.search(text[max(0, end - 16) : end])
    return m is not None and m.lastgroup in ("either", "called" if called else "plain")


def _js_slash(scan: Scan, m: re.Match, frame: Code) -> None:
    value = _value_before(scan.text, m.start(), "_$", ")]}", _JS_KEYWORDS)
    found = None if value else _REGEX.match(scan.text, m.start())
    frame.slash = -1 if found else m.start()
    if found:
        scan.at = found.end()


def _js_pattern_call(scan: Scan, m: re.Match, frame: Code) -> None:
    frame.carry(scan.text, m.start())
    scan.at = m.end()
    scan.frames.append(Arguments())


_js_plain, _js_module = quoted(QUOTES), quoted(_MODULE)


def _js_quote(scan: Scan, m: re.Match, frame: Code) -> None:
    if _guarded(scan, m.start(), frame, "_$"):
        return
    frame.carry(scan.text, m.start())
    (_js_module if names_module(scan.text, m.start()) else _js_plain)(scan, m, frame)


def _js_template(scan: Scan, m: re.Match, frame: Code) -> None:
    frame.slash = -1
    enter(scan, _JS_TEMPLATE, chain("string.templateLiteral"), m.end(), "`")


TYPESCRIPT = _lexicon(
    BRACE_EVENTS + "|" + SLASHES + rf"|(?P<slash>/)|(?P<call>(?<![{WORD_JS}])RegExp(?![{WORD_JS}])[ \t\n]*\()|(?P<template>`)|(?P<quote>['\"])",
    **BRACES, **_comments(), slash=_js_slash, call=_js_pattern_call, template=_js_template, quote=_js_quote,
)

# -- PHP ---------------------------------------------------------------------------------------------------------

_PHP_OPEN = re.compile(rf"<\?(?:[pP][hH][pP](?![{WORD}])|=)?")
_PHP_EVENTS = re.compile(r"(?P<close>\?>)|(?P<slashes>//)|(?P<hash>#(?!\[))|(?P<block>/\*)|(?P<double>\")|(?P<single>')|(?P<doc><<<)", re.S)
_PHP_LINE_STOP = re.compile(r"\n|\?>")
_PHP_IN_DOUBLE = re.compile(r"\\(?:.|\Z)|\"|(?P<hole>\{\$)", re.S)
_PHP_IN_HOLE = re.compile(r"\\(?:.|\Z)|[{}\"']", re.S)
_PHP_DOC = re.compile(r"<<<[ \t]*(['\"]?)([A-Za-z0-9_]+)")
_php_block, _php_single = block_comment(BLOCK, BLOCK_DOC), quoted(QUOTES)


def _php_double(scan: Scan, m: re.Match) -> None:
    text, at, closed = scan.text, m.end(), False
    while found := _PHP_IN_DOUBLE.search(text, at):
        at = found.end()
        if found[0] == '"':
            closed = True
            break
        if found["hole"]:
            at, depth = found.start(), 0
            while inner := _PHP_IN_HOLE.search(text, at):
                at = inner.end()
                if inner[0] in "\"'":
                    at = quoted_end(text, at, inner[0])[0]
                elif inner[0] in "{}":
                    depth += 1 if inner[0] == "{" else -1
                    if not depth:
                        break
            else:
                at = len(text)
    end = at if closed else len(text)
    scan.emit(m.start(), end, strip_delimited(text[m.start() : end], 1, 1, closed), QUOTES['"'])


def _php_doc(scan: Scan, m: re.Match) -> None:
    text, start = scan.text, m.start()
    head = _PHP_DOC.match(text, start)
    if not head:
        scan.at = start + 1
        return
    after = head.end() + (bool(head[1]) and text.startswith(head[1], head.end()))
    body = min(len(text), line_end(text, after) + 1)
    found = compiled(rf"{LINE_START}[ \t]*{head[2]}(?![{WORD}])").search(text, body)
    end = found.end() if found else len(text)
    tags = chain("string.nowdoc") if head[1] == "'" else chain("string.heredoc")
    scan.emit(start, end, strip_delimited(text[start:end], body - start, found.end() - found.start() if found else 0, found is not None), tags)


def php(text: str) -> list[Segment]:
    """PHP alternates between markup and code; markup is a segment of its own, the tags between them are code."""
    scan = Scan(text)
    none = Code()
    while scan.at < len(text):
        tag = _PHP_OPEN.search(text, scan.at)
        stop = tag.start() if tag else len(text)
        scan.fragment(scan.at, stop, chain("html"))
        if not tag:
            break
        scan.at = tag.end()
        while m := _PHP_EVENTS.search(text, scan.at):
            kind = m.lastgroup
            if kind == "close":
                scan.at = m.end()
                break
            if kind in ("slashes", "hash"):
                found = _PHP_LINE_STOP.search(text, m.start())
                end = found.start() if found else len(text)
                scan.emit(m.start(), end, strip_marker(text[m.start() : end], m.end() - m.start()), LINE)
                if found and found[0] == "?>":
                    scan.at = found.end()
                    break
            elif kind == "block":
                _php_block(scan, m, none)
            elif kind == "single":
                _php_single(scan, m, none)
            elif kind == "double":
                _php_double(scan, m)
            else:
                _php_doc(scan, m)
        else:
            scan.at = len(text)
    return scan.out


# ----------------------------------------------------------------------------------------------------------------

LEXICONS: dict[str, Callable[[], Lexicon]] = {
    "example": lambda: EXAMPLE, "c-cpp": _c_lexicon, "go": lambda: GO, "java": lambda: JAVA, "csharp": lambda: CSHARP,
    "python": lambda: PYTHON, "ruby": lambda: RUBY, "rust": lambda: RUST, "typescript": lambda: TYPESCRIPT,
}
SCANNERS = [*LEXICONS, "php"]


def scan(family: str, text: str) -> list[Segment]:
    """All segments of a text, gaps included."""
    if family == "php":
        return fill_gaps(php(text), text, raw=True)
    return fill_gaps(segments(LEXICONS[family](), text), text)


