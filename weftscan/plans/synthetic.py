"""Program text made from table columns piece by piece, so that SQL can say by arithmetic which segments it has."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.tags import tag_set


def lit(text: str) -> str:
    """A SQL expression of a text that Spark and DuckDB read alike: what they escape differently is spelt by number."""
    out, plain = [], ""
    for c in text:
        if c in "'\\\"" or ord(c) < 32 or ord(c) > 126:
            if plain:
                out.append(f"'{plain}'")
            plain = ""
            out.append(f"chr({ord(c)})")
        else:
            plain += c
    if plain or not out:
        out.append(f"'{plain}'")
    return "(" + " || ".join(out) + ")"


@dataclass(frozen=True)
class Piece:
    """One expected segment: SQL of its source, its text and its map (None: neither text nor map of its own), its tags."""

    raw: str
    text: str
    map: str | None
    tags: tuple[str, ...]
    has_raw: bool = True


def code(*parts: str) -> Piece:
    raw = " || ".join(parts)
    return Piece(raw, raw, None, ("code",), False)


def around(opening: str, body: str, closing: str, *leaves: str) -> Piece:
    """A delimited literal or comment whose body, a SQL expression, is not empty."""
    n = f"length({body})"
    tail = f" || ',{len(closing)},0'" if closing else ""
    spans = f"'{len(opening)},0,' || {n} || ',' || {n}{tail}"
    return Piece(" || ".join([lit(opening), body, *([lit(closing)] if closing else [])]), body, spans, tag_set(*leaves))


def marked(marker: str, body: str, *leaves: str) -> Piece:
    """A comment that its line ends."""
    return Piece(f"{lit(marker)} || {body}", body, f"'{len(marker)},0'", tag_set(*leaves))


def fragment(body: str, *leaves: str) -> Piece:
    """Part of a literal with holes."""
    return Piece(body, body, None, tag_set(*leaves))


def run(body: str, *leaves: str) -> Piece:
    """Part of a literal with holes, as the syntax walker gives it: with the lengths of its source and its text."""
    return Piece(body, body, f"length({body}) || ',' || length({body})", tag_set(*leaves))


def name(body: str, kind: str) -> Piece:
    return Piece(body, body, None, tag_set(f"identifier.{kind}"), False)


def source(pieces: list[Piece]) -> str:
    return " || ".join(p.raw for p in pieces)


def expected(pieces: list[Piece], table: str, key: str, keep=lambda tags: True, code_raw: bool = False) -> str:
    """SQL of the segments of a table's rows: file_id, pos, start_at, end_at, text, raw_text, map, tags."""
    rows = []
    for k, p in enumerate(pieces):
        if not keep(p.tags):
            continue
        start = " + ".join(["0", *[f"length({q.raw})" for q in pieces[:k]]])
        raw = p.raw if p.has_raw or code_raw else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT {key} AS file_id, {k} AS pos, {start} AS start_at, {start} + length({p.raw}) AS end_at, {p.text} AS text, {raw} AS raw_text, "
            f"{p.map or 'CAST(NULL AS VARCHAR)'} AS map, '{' '.join(p.tags)}' AS tags FROM {table}"
        )
    cast = "CAST(file_id AS BIGINT) AS file_id, CAST(pos AS INTEGER) AS pos, CAST(start_at AS INTEGER) AS start_at, CAST(end_at AS INTEGER) AS end_at"
    return f"SELECT {cast}, text, raw_text, map, tags FROM (" + " UNION ALL ".join(rows) + ")"
