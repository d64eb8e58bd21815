"""The catalogue as relations: the questions and changes of plugins as DataFrame operations.

A parsers table is what ``Plugin.to_df`` gives (plugin, ordinal, name, scanner, file_types, filter). Such tables are
small; order is kept in ``ordinal`` columns, never in the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import VOCABULARY, first_segment, meaning
from ..functions.text import csv_field, wrap_list
from .catalog import SINGLE, Plugin


def by_file_type(parsers: DataFrame) -> DataFrame:
    """ordinal, name, type_ordinal, file_type: a row for each type of each parser."""
    return parsers.select("ordinal", "name", F.posexplode("file_types").alias("type_ordinal", "file_type"))


def check_names(parsers: DataFrame) -> DataFrame:
    """name, n of parser names that are invalid or used more than once; empty for a sound plugin."""
    return parsers.groupBy("name").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("name").isin("", "*"))


def names(parsers: DataFrame) -> DataFrame:
    return parsers.select("ordinal", "name")


def supported_file_types(parsers: DataFrame) -> DataFrame:
    """position, file_type: distinct types in the order of first mention."""
    first = by_file_type(parsers).groupBy("file_type").agg(F.min(F.struct("ordinal", "type_ordinal")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("position"), "file_type")


def parser(parsers: DataFrame, name: str) -> DataFrame:
    return parsers.where(F.col("name") == name)


def names_for(parsers: DataFrame, file_type: str) -> DataFrame:
    return parsers.where(F.array_contains("file_types", file_type)).select("ordinal", "name")


def serving(parsers: DataFrame) -> DataFrame:
    """file_type, parser: the last parser that lists a type serves it."""
    return by_file_type(parsers).groupBy("file_type").agg(F.max_by("name", "ordinal").alias("parser"))


def resolve(parsers: DataFrame, wanted: DataFrame) -> DataFrame:
    """The parsers that ``wanted`` (name) lists."""
    return parsers.join(wanted, "name", "left_semi").select(*parsers.columns)


def unknown(parsers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names in ``wanted`` (name) that no parser has."""
    return wanted.join(parsers, "name", "left_anti")


def unknown_types(parsers: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(by_file_type(parsers), "file_type", "left_anti")


def _settings(rows: DataFrame, by: str) -> DataFrame:
    """Rows (ordinal, name, file_type, ``by``) joined to one row for each parser."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, "file_type"))), lambda x: x["file_type"]), ",")
    return rows.groupBy("ordinal", "name").agg(listed.alias("language_id")).select("ordinal", "language_id", F.col("name").alias("parser"))


def language_settings(parsers: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """ordinal, language_id, parser: of the parsers in ``wanted`` (name), or all, each with the types it serves among them."""
    chosen = parsers if wanted is None else resolve(parsers, wanted)
    own = by_file_type(chosen)
    mine = own.join(serving(chosen).withColumnRenamed("parser", "name"), ["file_type", "name"], "left_semi")
    return _settings(mine, "type_ordinal")


def language_settings_for_types(parsers: DataFrame, types: DataFrame) -> DataFrame:
    """The same for ``types`` (request_ordinal, file_type), in the order they are asked for."""
    hit = types.join(serving(parsers), "file_type").withColumnRenamed("parser", "name")
    return _settings(hit.join(parsers.select("name", "ordinal"), "name"), "request_ordinal")


def append(parsers: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` after ``parsers``, so that it serves its types."""
    last = parsers.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("base"))
    moved = more.crossJoin(F.broadcast(last)).withColumn("ordinal", (F.col("ordinal") + F.col("base")).cast("int")).select(*parsers.columns)  # one row
    return parsers.unionByName(moved)


def duplicate(parsers: DataFrame, name: str, new_name: str) -> DataFrame:
    return append(parsers, parser(parsers, name).withColumn("name", F.lit(new_name)).withColumn("ordinal", F.lit(0)))


def rename(parsers: DataFrame, name: str, new_name: str) -> DataFrame:
    return parsers.withColumn("name", F.when(F.col("name") == name, new_name).otherwise(F.col("name")))


def remove(parsers: DataFrame, gone: DataFrame) -> DataFrame:
    return parsers.join(gone, "name", "left_anti").select(*parsers.columns)


def _types(parsers: DataFrame, name: str, types: Column) -> DataFrame:
    hit = F.lit(True) if name == "*" else F.col("name") == name
    return parsers.withColumn("file_types", F.when(hit, F.array_distinct(types)).otherwise(F.col("file_types")))


def set_types(parsers: DataFrame, name: str, types: list[str]) -> DataFrame:
    return _types(parsers, name, F.array(*map(F.lit, types)).cast("array<string>"))


def add_types(parsers: DataFrame, name: str, types: list[str]) -> DataFrame:
    return _types(parsers, name, F.concat("file_types", F.array(*map(F.lit, types)).cast("array<string>")))


def remove_types(parsers: DataFrame, name: str, types: list[str]) -> DataFrame:
    return _types(parsers, name, F.filter("file_types", lambda t: ~t.isin(*types)))


def set_filter(parsers: DataFrame, name: str, options: dict[str, bool]) -> DataFrame:
    rules = F.create_map(*[F.lit(x) for kv in options.items() for x in kv]) if options else F.lit(None)
    hit = F.lit(True) if name == "*" else F.col("name") == name
    return parsers.withColumn("filter", F.when(hit, rules.cast("map<string,boolean>")).otherwise(F.col("filter")))


def filter_for_type(parsers: DataFrame, file_type: str, options: dict[str, bool], new_name: str) -> DataFrame:
    """A copy of the parser that serves the type, for that type alone, with these rules."""
    last = names_for(parsers, file_type).agg(F.max_by("name", "ordinal").alias("name"))
    copy = resolve(parsers, last).withColumn("name", F.lit(new_name)).withColumn("ordinal", F.lit(0))
    return append(parsers, set_filter(set_types(copy, new_name, [file_type]), new_name, options))


def define_config(settings: DataFrame, own: DataFrame) -> DataFrame:
    """ordinal, language_id, parser: a plugin's rows, then the user's, which so win."""
    both = settings.select(F.lit(0).alias("src"), "ordinal", "language_id", "parser").unionByName(own.select(F.lit(1).alias("src"), "ordinal", "language_id", "parser"))
    return both.select((F.row_number().over(Window.orderBy("src", "ordinal")) - 1).alias("ordinal"), "language_id", "parser")


def effective(settings: DataFrame) -> DataFrame:
    """file_type, parser: what a configuration comes to, of several rows for a type the last."""
    each = settings.select("ordinal", F.explode(F.split("language_id", ",")).alias("file_type"), "parser")
    return each.groupBy("file_type").agg(F.max_by("parser", "ordinal").alias("parser"))


def registered(parsers: DataFrame) -> DataFrame:
    """name, scanner of parsers registered one after the other: of those of one name the last stays."""
    return parsers.groupBy("name").agg(F.max_by("scanner", "ordinal").alias("scanner"))


def bundle(spark: SparkSession, plugins: list[Plugin] | None = None) -> DataFrame:
    """The parsers of several plugins as one table, in order."""
    return reduce(append, [p.to_df(spark) for p in (list(SINGLE.values()) if plugins is None else plugins)])


def bundled_tags(spark: SparkSession) -> DataFrame:
    """tag, meaning, language of every family."""
    rows = [(t, meaning(f, t), lang) for f, p in SINGLE.items() for t in VOCABULARY[f] for lang in p.supported_file_types]
    return spark.createDataFrame(rows, "tag string, meaning string, language string")


def merge_tags(tags: DataFrame) -> DataFrame:
    """tag, meaning, languages (sorted): a row for each meaning of each tag."""
    return tags.groupBy("tag", "meaning").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def tags_table(merged: DataFrame, n: int, width: int = 36) -> DataFrame:
    """tag, meaning, languages as a text: ``all`` where every language has the row, else wrapped lines."""
    listed = wrap_list(F.transform("languages", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), width)
    return merged.select(F.concat(F.lit("`"), "tag", F.lit("`")).alias("tag"), csv_field(F.col("meaning")).alias("meaning"), csv_field(F.when(F.size("languages") == n, "all").otherwise(listed)).alias("languages"))


def language_ids(parsers: DataFrame) -> DataFrame:
    """language_id, parser, recommended ('yes' for a type's last parser, else empty)."""
    each = by_file_type(parsers).groupBy("file_type", "name").agg(F.max("ordinal").alias("ordinal"))
    order = Window.partitionBy("file_type").orderBy("ordinal")
    last = F.lead("name").over(order).isNull()
    return each.select(F.col("file_type").alias("language_id"), F.col("name").alias("parser"), F.when(last, "yes").otherwise("").alias("recommended"))


def packages(spark: SparkSession) -> DataFrame:
    """package, languages, tags: of each family, its sorted types and the first segments of its tags that are on."""
    rows = [(p.name, lang, t, on) for p in SINGLE.values() for parser in p.parsers for lang in parser.file_types for t, on in parser.tags.items()]
    flat = spark.createDataFrame(rows, "package string, language string, tag string, default_on boolean")
    tags = F.sort_array(F.collect_set(F.when(F.col("default_on"), first_segment(F.col("tag")))))
    return flat.groupBy("package").agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.array_join(tags, ",").alias("tags"))


def route(files: DataFrame, served: DataFrame) -> DataFrame:
    """Files with the parser that serves their type, null where there is none."""
    return files.join(served, "file_type", "left")
