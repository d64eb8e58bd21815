"""Sources of program text and sinks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types by extension, a default that callers may replace.
EXTENSIONS = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go", "java": "java", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "javascriptreact", "php": "php", "py": "python", "pyi": "python", "rb": "ruby", "rs": "rust", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescriptreact",
}


def read_tree(spark: SparkSession, path: str, glob: str | None = None, charset: str = "UTF-8", extensions: dict[str, str] | None = None) -> DataFrame:
    """All files below ``path`` as (file_id, filename, file_type, content), each a row; ids are hashes of the names.

    They are read as bytes and decoded, as the text source drops a last line end.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return from_binary(reader.load(path), charset, extensions)


def from_binary(raw: DataFrame, charset: str = "UTF-8", extensions: dict[str, str] | None = None) -> DataFrame:
    """Files from rows of the binary source, of a batch or a stream."""
    return as_files(raw.select(F.col("path").alias("filename"), F.decode("content", charset).alias("content")), extensions=extensions)


def read_text(spark: SparkSession, path: str, extensions: dict[str, str] | None = None) -> DataFrame:
    """The same by the text source in whole files, without their last line end."""
    raw = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    return as_files(raw.withColumn("filename", F.input_file_name()).withColumnRenamed("value", "content"), extensions=extensions)


def as_files(df: DataFrame, content: str = "content", filename: str = "filename", file_type: str | None = None, extensions: dict[str, str] | None = None) -> DataFrame:
    """Any table with a text column as files; without ``file_type`` the name's extension tells it."""
    kind = F.col(file_type) if file_type else type_of(F.col(filename), extensions)
    key = F.col("file_id").cast("long") if "file_id" in df.columns else F.xxhash64(F.col(filename))
    return df.select(key.alias("file_id"), F.col(filename).alias("filename"), kind.alias("file_type"), F.col(content).alias("content"))


def type_of(filename: Column, extensions: dict[str, str] | None = None) -> Column:
    table = EXTENSIONS if extensions is None else extensions
    ending = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ending)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated values with a header; quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_issues(df: DataFrame, path: str) -> None:
    """Issues (uri, text, row, col) as JSON lines in their order."""
    df.orderBy("uri", "row", "col", "text").write.mode("overwrite").json(path)
