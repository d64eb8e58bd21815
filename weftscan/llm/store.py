"""Where intermediate tables go, and joins: a side is broadcast only if it was counted before."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a side that may be broadcast; both are counted before each join. The driver holds a side several
#: times over, and sides of some joins at once, in a heap that may be small.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Rows in an Arrow batch: whole documents, so batches stay small.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset (local tests), a folder of this process is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftscan-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and lost executors cost only a reread.

    ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """What a value takes in a hashed relation, in bytes, whatever its type."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType))
        return F.coalesce(inner, F.lit(0).cast("long")) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def fits_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table has at most ``rows`` rows and ``size`` bytes, as counted over at most ``rows`` + 1 of them."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in small.schema), F.lit(16).cast("long"))
    n, total = small.limit(rows + 1).select(width.alias("w")).agg(F.count("*"), F.sum("w")).first()
    return n <= rows and (total or 0) <= size


def join_sized(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, nulls: bool = True) -> DataFrame:
    """Join on null-safe equality; ``small`` is broadcast only if it is counted at ``limit`` rows or fewer and BROADCAST_BYTES.

    Beyond the limits it is a shuffled join, whose hot keys adaptive execution splits. ``small`` should be a
    stored table, as it is counted here and read again. Without ``nulls`` keys are compared by plain equality.
    """
    small = F.broadcast(small) if fits_broadcast(small, limit) else small.hint("merge")
    if not nulls:
        return df.join(small, on, how)
    for c in on:
        small = small.withColumnRenamed(c, f"__{c}")
    cond = None
    for c in on:
        one = df[c].eqNullSafe(small[f"__{c}"])
        cond = one if cond is None else cond & one
    return df.join(small, cond, how).drop(*[f"__{c}" for c in on])


def join_shuffled(df: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join on plain equality by sorting both sides, neither of which was counted.

    Left to itself, Spark broadcasts what it supposes to be small, and it takes what an explode makes to be as large as
    what it was made of: millions of rows went to the driver.
    """
    return df.join(other.hint("merge"), on, how)
