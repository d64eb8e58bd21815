"""Tokens of JavaScript and TypeScript, read on demand: what a slash or an angle bracket means is the parser's to say."""

from __future__ import annotations

import re

_WORD_START = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
WORD = re.compile(rf"{_WORD_START}(?:\w|\$|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}}|[\u200c\u200d])*")
PRIVATE = re.compile("#" + WORD.pattern)
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?")
TRIVIA = re.compile(r"(?:[\s\ufeff]+|(?P<line>//[^\n\r\u2028\u2029]*)|(?P<block>/\*.*?(?:\*/|\Z)))", re.S)
STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n\r]|\\(?:\r\n|.))*+{q}", re.S) for q in "'\""}
MARKUP_STRING = {q: re.compile(rf"{q}[^{q}]*{q}") for q in "'\""}
ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|[0-7]{1,3}|\r\n|.)", re.S)
REGEX = re.compile(r"/(?![*/])(?:[^\n\r\\\[/]|\\[^\n\r]|\[(?:[^\n\r\\\]]|\\[^\n\r])*+\])++/[A-Za-z]*")
TEMPLATE_STOP = re.compile(r"\\|`|\$\{")
REFERENCE = re.compile(r"&(?:#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,5})|[A-Za-z]{1,30});")
MARKUP_TEXT = re.compile(r"[^{}<>]+")
MARKUP_NAME = re.compile(r"(?:[^\W\d]|\$)(?:[\w$-])*")
PUNCTUATION = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?![0-9])|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
BREAK = re.compile("[\n\r\u2028\u2029]")


class Token:
    __slots__ = ("kind", "start", "end", "text", "broken")

    def __init__(self, kind: str, start: int, end: int, text: str, broken: bool):
        self.kind, self.start, self.end, self.text, self.broken = kind, start, end, text, broken


class Reader:
    """A cursor over a text with one token of look-ahead. Going back is setting ``at``; comments are kept by position."""

    def __init__(self, text: str):
        self.text = text
        self.comments: dict[int, int] = {}
        self.memo: dict[int, Token] = {}
        self.at = 0
        if text.startswith("#!"):
            self.at = (BREAK.search(text) or re.compile(r"\Z").search(text)).start()

    def token(self) -> Token:
        """The token at the cursor, blanks and comments before it skipped."""
        found = self.memo.get(self.at)
        if found is None:
            found = self.memo[self.at] = self._read(self.at)
        return found

    def _read(self, at: int) -> Token:
        text, begin = self.text, at
        while m := TRIVIA.match(text, at):
            if m.lastgroup:
                self.comments[m.start()] = m.end()
            at = m.end()
        broken = BREAK.search(text, begin, at) is not None
        if at >= len(text):
            return Token("end", at, at, "", broken)
        c = text[at]
        if m := WORD.match(text, at):
            return Token("word", at, m.end(), m[0], broken)
        if c in "'\"" and (m := STRING[c].match(text, at)):
            return Token("string", at, m.end(), m[0], broken)
        if (c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit())) and (m := NUMBER.match(text, at)):
            return Token("number", at, max(m.end(), at + 1), m[0], broken)
        if c == "#" and (m := PRIVATE.match(text, at)):
            return Token("private", at, m.end(), m[0], broken)
        if c == "`":
            return Token("template", at, at + 1, c, broken)
        m = PUNCTUATION.match(text, at)
        return Token("mark", at, m.end() if m else at + 1, m[0] if m else c, broken)

    def peek_after(self, t: Token) -> Token:
        keep, self.at = self.at, t.end
        found = self.token()
        self.at = keep
        return found
