"""Tag filters: specificity-ranked wildcard rules, compiled on the driver into one column expression.

A rule names a tag, or tags by wildcards. For each declared tag the most specific rule that matches it decides its
verdict and weight; explicit rules outweigh ``*``, which outweighs the tag's own default. The heaviest tag that a
segment carries decides about the segment; tags of equal weight in the order of declaration.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of a tag's default, of the rule ``*``, and what is added to an explicit rule's specificity.
DEFAULT, WILDCARD, EXPLICIT = 1, 2, 3

Options = Mapping[str, "bool | None"]


def normalised(options: Options | None) -> dict[str, bool] | None:
    """Options without undefined entries; none where nothing is left."""
    kept = {k: v for k, v in (options or {}).items() if v is not None}
    return kept or None


def _rules(options: Mapping[str, bool]) -> list[tuple[int, int, re.Pattern, int, bool]]:
    """(kind, rank, pattern, specificity, verdict) in order of trial: exact names, then prefixes, the longest first, then others."""
    out = []
    for order, (pattern, verdict) in enumerate(options.items()):
        star = pattern.find("*")
        if pattern == "*":
            continue
        if star < 0:
            out.append((0, order, re.compile(re.escape(pattern) + r"\Z"), len(pattern), verdict))
        elif star == len(pattern) - 1:
            out.append((1, -star * 1000 + order, re.compile(re.escape(pattern[:-1])), star, verdict))
        else:
            body = ".*".join(map(re.escape, pattern.split("*")))
            out.append((2, order, re.compile(body + r"\Z"), star, verdict))
    return sorted(out, key=lambda r: r[:2])


def scores(options: Options, known: Mapping[str, bool]) -> dict[str, int]:
    """The signed weight of every declared tag, positive where it keeps a segment."""
    given = normalised(options) or {}
    rules, wildcard = _rules(given), given.get("*")
    out = {}
    for tag, default in known.items():
        best, verdict = -1, None
        for _, _, pattern, specificity, says in rules:
            if specificity > best and pattern.match(tag):
                best, verdict = specificity, says
        if verdict is not None:
            weight = best + EXPLICIT
        elif wildcard is not None:
            weight, verdict = WILDCARD, wildcard
        else:
            weight, verdict = DEFAULT, default
        out[tag] = weight if verdict else -weight
    return out


def ordered(options: Options, known: Mapping[str, bool]) -> list[tuple[str, bool]]:
    """Declared tags with their verdicts, the heaviest first; equal ones stay in declaration order."""
    return [(t, s > 0) for t, s in sorted(scores(options, known).items(), key=lambda x: -abs(x[1]))]


def otherwise(options: Options) -> bool:
    """What becomes of segments that carry no declared tag."""
    given = (normalised(options) or {}).get("*")
    return True if given is None else given


def keeps_everything(options: Options | None, known: Mapping[str, bool]) -> bool:
    return normalised(options) is None and all(known.values())


def keeps(options: Options, known: Mapping[str, bool], tags) -> bool:
    """The plain form of the predicate, for one segment's true tags; None stands for no tags at all."""
    for tag, verdict in ordered(options, known):
        if tags is not None and tag in tags:
            return verdict
    return otherwise(options)


def predicate(options: Options | None, known: Mapping[str, bool], tags: Column) -> Column:
    """A boolean column over a column of tag arrays; a literal true where nothing would be filtered."""
    if keeps_everything(options, known):
        return F.lit(True)
    cases = F
    for tag, verdict in ordered(options or {}, known):
        cases = cases.when(F.array_contains(tags, tag), F.lit(verdict))
    rest = F.lit(otherwise(options or {}))
    return F.coalesce(cases.otherwise(rest), rest)


def filter_segments(segments: Column, options: Options | None, known: Mapping[str, bool]) -> Column:
    """A row's segments that the rules keep, in order; call it before exploding, as nothing is pushed below that."""
    if keeps_everything(options, known):
        return segments
    return F.filter(segments, lambda s: predicate(options, known, s["tags"]))
