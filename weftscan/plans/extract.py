"""Files to segments through a plugin: route each file to its parser, scan, filter, explode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import source_offset
from ..operators.extract import exploded, rows, run_scanner
from ..operators.regex_scan import starts
from ..schema import SEGMENT, SEGMENTS_DDL
from .catalog import Parser, Plugin


#: Bytes of text in a batch that goes to a Python scanner; files may be large.
BATCH_BYTES = 16 << 20


def serving(plugin: Plugin, settings: list[dict[str, str]] | None = None) -> dict[str, Parser]:
    """File type to parser as language settings say; of several rows the last wins, and so it does among parsers of a name."""
    by_name = {p.name: p for p in plugin.parsers}
    out = {}
    for row in plugin.language_settings() if settings is None else settings:
        for file_type in row["languageId"].split(","):
            if row["parser"] in by_name:
                out[file_type.strip()] = by_name[row["parser"]]
    return out


def parsed(files: DataFrame, plugin: Plugin, settings: list[dict[str, str]] | None = None, keep_all: bool = False) -> DataFrame:
    """``files`` with ``parser`` and ``segments``; files of no parser have nulls.

    The table of file types is a handful of rows, so routing is a CASE over literals: no join, no shuffle, and one
    pass over the files, in which each scanner runs for its own rows only.
    """
    route = serving(plugin, settings)
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if not route:
        return files.withColumn("parser", F.lit(None).cast("string")).withColumn("segments", F.lit(None).cast(SEGMENTS_DDL))
    kind, name, segments = F.col("file_type"), F, F
    for parser in dict.fromkeys(id(p) for p in route.values()):
        own = [t for t, p in route.items() if id(p) == parser]
        one = next(p for p in route.values() if id(p) == parser)
        content = F.when(kind.isin(*own), F.col("content"))  # other rows reach a Python scanner as nulls
        found = one.parse_all(content) if keep_all else one.parse(content)
        name, segments = name.when(kind.isin(*own), F.lit(one.name)), segments.when(kind.isin(*own), found)
    return files.withColumn("parser", name).withColumn("segments", segments)


def extract(files: DataFrame, plugin: Plugin, settings: list[dict[str, str]] | None = None, keep_all: bool = False) -> DataFrame:
    """file_id, filename, file_type, parser and a row for each segment; contents are not carried along."""
    return exploded(parsed(files, plugin, settings, keep_all), keep=["file_id", "filename", "file_type", "parser"])


def extract_union(files: DataFrame, plugin: Plugin, settings: list[dict[str, str]] | None = None, keep_all: bool = False) -> DataFrame:
    """The same as one branch for each parser, each with its own filter on file types: for sources partitioned by type."""
    route = serving(plugin, settings)
    parts = []
    for parser in plugin.parsers:
        own = [t for t, p in route.items() if p is parser]
        if own:
            some = files.where(F.col("file_type").isin(*own)).withColumn("parser", F.lit(parser.name))
            content = F.col("content")
            parts.append(exploded(some.withColumn("segments", parser.parse_all(content) if keep_all else parser.parse(content)), keep=["file_id", "filename", "file_type", "parser"]))
    return reduce(DataFrame.unionByName, parts)


def register_udtf(spark: SparkSession, name: str = "scan_segments") -> None:
    """``SELECT ... FROM files, LATERAL scan_segments(content, scanner)`` for the scanners of this package."""
    from pyspark.sql.functions import udtf

    class ScanSegments:
        def eval(self, content: str, scanner: str):
            for r in rows(run_scanner(scanner, content)) if content is not None else ():
                yield tuple(r[k] for k in ("pos", "start", "end", "text", "raw_text", "map", "tags"))

    kind = T.StructType([T.StructField(f.name, f.dataType) for f in SEGMENT])
    spark.udtf.register(name, udtf(ScanSegments, returnType=kind))


def words(segments: DataFrame) -> DataFrame:
    """The words of segments, each with its place in the segment's text: a first step of a spelling check."""
    pieces = F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}\p{M}'\u2019]*+|[^\p{L}]++"), F.lit(0))
    cut = segments.withColumn("__p", pieces)
    each = F.arrays_zip(F.col("__p").alias("word"), starts(F.transform("__p", F.length)).alias("offset"))
    found = F.filter(each, lambda z: z["word"].rlike(r"^\p{L}"))
    return cut.select(*segments.columns, F.explode(found).alias("__w")).select(*segments.columns, "__w.word", "__w.offset")


def issues(files: DataFrame, segments: DataFrame, known: DataFrame) -> DataFrame:
    """uri, text, row, col of words that ``known`` (word) lacks; rows and columns count from 1, in code points.

    Maps lead from a word in the normalised text back to its source. The word list is joined by its own size: no hint
    forces a broadcast.
    """
    missing = words(segments).withColumn("w", F.lower("word")).join(known.select(F.lower("word").alias("w")).distinct(), "w", "left_anti")
    place = F.col("start") + source_offset(F.col("map"), F.col("offset"))
    spots = missing.select("file_id", place.alias("at"), F.lit(1).alias("kind"), F.col("filename").alias("uri"), F.col("word").alias("text"))
    lines = starts(F.transform(F.split("content", "\n", -1), lambda x: F.length(x) + 1))
    begins = files.select("file_id", F.explode(lines).alias("at"), F.lit(0).alias("kind"))
    by = Window.partitionBy("file_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = begins.unionByName(spots, allowMissingColumns=True)
    row = F.count(F.when(F.col("kind") == 0, 1)).over(by).cast("int")
    col = (F.col("at") - F.max(F.when(F.col("kind") == 0, F.col("at"))).over(by) + 1).cast("int")
    found = both.select("kind", "uri", "text", row.alias("row"), col.alias("col")).where("kind = 1").drop("kind")
    return found.orderBy("uri", "row", "col", "text")
