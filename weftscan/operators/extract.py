"""Segments of a table of files: the scanner of each row's parser, the tag filter of that parser, then rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..schema import SEGMENT, SEGMENTS
from . import lexicons, regex_scan

#: Grammars of the syntax-tree family.
GRAMMARS = ("javascript", "typescript", "tsx")


def run_scanner(scanner: str, text: str) -> list[tuple]:
    """Segments of one text by a scanner's name; ``tree-<grammar>`` walks a syntax tree."""
    if scanner.startswith("tree-"):
        from .walker import walk

        return walk.segments(scanner[5:], text)
    return lexicons.scan(scanner, text)


def rows(found: list[tuple]) -> list[dict]:
    return [{"pos": k, "start": s[0], "end": s[1], "text": s[2], "raw_text": s[3], "map": s[4], "tags": list(s[5])} for k, s in enumerate(found)]


def columns(found: list[list[tuple] | None]) -> pa.Array:
    """Segments of several texts as one Arrow array of lists of structs; None stays null. No row of Python objects is made."""
    flat = [s for one in found if one is not None for s in one]
    sizes = np.array([0, *(len(one) if one is not None else 0 for one in found)])
    ends = pa.array(np.cumsum(sizes), pa.int32())
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes)[:-1], sizes[1:])
    maps, map_ends = _lists([s[4] for s in flat], pa.int32())
    tags, tag_ends = _lists([s[5] for s in flat], pa.string())
    no_map = pa.array([s[4] is None for s in flat], pa.bool_())
    parts = [
        pa.array(pos, pa.int32()), pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.string()),
        pa.array([s[3] for s in flat], pa.string()), pa.ListArray.from_arrays(map_ends, maps, mask=no_map), pa.ListArray.from_arrays(tag_ends, tags),
    ]
    structs = pa.StructArray.from_arrays(parts, names=SEGMENT.names)
    return pa.ListArray.from_arrays(ends, structs, mask=pa.array([one is None for one in found], pa.bool_()))


def _lists(values: list, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    ends = np.cumsum([0, *(len(v) if v is not None else 0 for v in values)])
    return pa.array([x for v in values if v is not None for x in v], kind), pa.array(ends, pa.int32())


@lru_cache(maxsize=None)
def scanner_udf(scanner: str):
    """An Arrow function from texts to arrays of segments, a batch at a time."""

    def run(texts: pa.Array) -> pa.Array:
        return columns([None if t is None else run_scanner(scanner, t) for t in texts.to_pylist()])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, SEGMENTS)


def scan(content: Column, scanner: str, native: bool = True) -> Column:
    """array<segment> of a text column, gaps included. Regular languages run as built-in functions unless ``native`` is false."""
    if native and scanner in regex_scan.FAMILIES:
        return regex_scan.scan(content, scanner)
    return scanner_udf(scanner)(content)


def exploded(df: DataFrame, segments: str | Column = "segments", keep: list[str] | None = None) -> DataFrame:
    """One row for each segment, with the columns ``keep`` (all others by default); content is best left out of it."""
    keep = [c for c in df.columns if c != "segments"] if keep is None else keep
    return df.select(*keep, F.explode(segments).alias("__s")).select(*keep, "__s.*")
