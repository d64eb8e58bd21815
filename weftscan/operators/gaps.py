"""What lies between segments, tagged as code: as a window over rows, or as a function of one row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import SEGMENTS_DDL

#: Position of the row that stands for a file's end; it comes after every segment.
SENTINEL = 2147483647


def fill_rows(files: DataFrame, segments: DataFrame, key: str = "file_id", tags: tuple[str, ...] = ("code",), with_raw: bool = False) -> DataFrame:
    """``segments`` (key, pos, start, end, text, raw_text, map, tags) and a row for each gap in ``files`` (key, content).

    Each gap begins where the segment before it in emission order ended. Rows keep the order (start of the gap or
    segment within the emission); ``pos`` is numbered anew. One shuffle by ``key`` serves the window and the join.
    """
    columns = [key, "pos", "start", "end", "text", "raw_text", "map", "tags"]
    n = F.length("content")
    ends = files.select(key, F.lit(SENTINEL).alias("pos"), n.alias("start"), n.alias("end"))
    edges = segments.select(key, "pos", "start", "end").unionByName(ends)
    by = Window.partitionBy(key).orderBy("pos")
    gaps = edges.withColumn("from", F.coalesce(F.lag("end").over(by), F.lit(0))).where(F.col("start") > F.col("from"))
    cut = gaps.join(files.select(key, "content"), key).select(
        key, (F.col("pos") * 2.0 - 1).alias("order"), F.col("from").alias("start"), F.col("start").alias("end"),
        F.col("content").substr(F.col("from") + 1, F.col("start") - F.col("from")).alias("text"),
    )
    raw = F.col("text") if with_raw else F.lit(None).cast("string")
    cut = cut.select(key, "order", "start", "end", "text", raw.alias("raw_text"), F.lit(None).cast("array<int>").alias("map"), F.array(*[F.lit(t) for t in tags]).alias("tags"))
    own = segments.select(key, (F.col("pos") * 2.0).alias("order"), *columns[2:])
    both = own.unionByName(cut)
    pos = (F.row_number().over(Window.partitionBy(key).orderBy("order")) - 1).alias("pos")
    return both.select(key, pos, *columns[2:])


def fill_array(segments: Column, content: Column, tags: tuple[str, ...] = ("code",), with_raw: bool = False) -> Column:
    """The segments of one row with the gaps between them; ``pos`` is numbered anew. An empty content gives none."""
    raw = lambda text: text if with_raw else F.lit(None).cast("string")
    none = F.array().cast(SEGMENTS_DDL)

    def gap(start: Column, end: Column) -> Column:
        text = content.substr(start + 1, end - start)
        return F.struct(F.lit(0).alias("pos"), start.alias("start"), end.alias("end"), text.alias("text"), raw(text).alias("raw_text"), F.lit(None).cast("array<int>").alias("map"), F.array(*[F.lit(t) for t in tags]).alias("tags"))

    def filled(own: Column) -> Column:
        end_before = lambda k: F.coalesce(F.get(own, k - 1)["end"], F.lit(0))
        with_gap = lambda s, k: let(end_before(k), lambda at: F.when(s["start"] > at, F.array(gap(at, s["start"]), s)).otherwise(F.array(s)))
        tail = let(end_before(F.size(own)), lambda at: F.when(F.length(content) > at, F.array(gap(at, F.length(content)))).otherwise(none))
        both = F.concat(F.flatten(F.transform(own, with_gap)).cast(SEGMENTS_DDL), tail.cast(SEGMENTS_DDL))
        return F.transform(both, lambda s, k: s.withField("pos", k.cast("int")))

    return let(segments, filled)


def coverage(segments: Column, content: Column) -> Column:
    """Whether the segments' sources, joined in order, are the whole content: each begins where the one before it ends."""

    def whole(own: Column) -> Column:
        end = lambda k: F.coalesce(F.get(own, k)["end"], F.lit(0))
        meets = F.forall(F.transform(own, lambda s, k: s["start"] == end(k - 1)), lambda x: x)
        return meets & (end(F.size(own) - 1) == F.length(content))

    return let(segments, whole)
