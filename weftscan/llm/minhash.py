"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Each text gives its set of five-word shingles (64-bit hashes), a digest of the set, 128 minima, of which bands
   of four are hashed as keys and the low four bits are packed as a signature. Texts with equal sets form one
   class; everything below works on classes.
2. Each band bucket proposes the pairs of its least member with every other: as many pairs as rows, however large
   the bucket. Pairs whose collision-corrected similarity, estimated by bit counts, is too low to reach the
   threshold are dropped; the others are confirmed on full sets, and components are found.
3. A bucket whose members still lie in several components holds pairs not yet compared. Its rows are dealt in
   blocks to triangular cells of bounded size, where sizes and signatures are compared. Rows with a promising
   partner of another component go to such cells once more, with their full sets, and only links that connect
   something leave them. So every pair that shares a bucket is compared, once, unless its members are connected
   already; no bucket is capped, and pairs are not written out.

At a similarity of 0.75 a pair shares none of 32 bands with a probability of 5e-6; the margin of the estimate is
6 standard deviations. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .store import join_shuffled, join_sized, narrow_batches, table

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BITS = 4
#: Pairs whose estimate is below this cannot reach 0.75: it is six standard deviations lower.
LEAST_ESTIMATE = 0.5
#: Rows in one block of a bucket's triangular cells.
BLOCK = 256

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, MINIMA, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * _U(2)
_STEP = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text in UTF-8; of its whole word sequence if that is shorter."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, SHINGLE)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total = total * _STEP + h[k : n - size + 1 + k]
    return np.unique(_mix(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """128 minima of 32 bits each of a set that is not empty."""
    out = np.full(MINIMA, 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = (_A[:, None] * hashes[None, at : at + 4096] + _B[:, None]) >> _U(32)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> bytes:
    """The low four bits of each minimum, two minima a byte."""
    low = (least & _U(2**BITS - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _STEP + rows[:, k])
    return key.view(np.int64)


_DIFFERENT = np.array([(x >> 4 > 0) + (x & 15 > 0) for x in range(256)], np.uint8)


def estimate(different: np.ndarray) -> np.ndarray:
    """Similarity from the number of unequal b-bit values, with chance collisions taken out."""
    chance = 2.0**-BITS
    return ((1 - different / MINIMA) - chance) / (1 - chance)


FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_id", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
])
SETS = T.StructType([T.StructField("set_id", T.BinaryType()), T.StructField("hashes", T.BinaryType())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.encode(F.col("text").cast("string"), "UTF-8").alias("b"))


def _features(docs: DataFrame) -> DataFrame:
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                if len(s):
                    least = minima(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(least), band_keys(least)))
                else:
                    rows.append((0, None, None, None))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=FEATURES.names)

    return _texts(docs).mapInArrow(run, FEATURES)


def _sets(texts: DataFrame) -> DataFrame:
    """set_id and sorted hashes of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x) for x in batch.column(0).to_pylist()]
            found = [s.tobytes() for s in found if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())], names=SETS.names)

    return texts.select("b").mapInArrow(run, SETS)


@pandas_udf(T.DoubleType())
def estimated(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), np.uint8) ^ np.frombuffer(b"".join(b), np.uint8)
    return pd.Series(estimate(_DIFFERENT[x].reshape(len(a), -1).sum(axis=1, dtype=np.int64)))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


@pandas_udf(T.BooleanType())
def linked(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype="bool")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Only texts of classes in a pair are read into sets."""
    sets = _sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), classes, docs)
    one, two = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    return join_shuffled(join_shuffled(pairs.select("a", "b"), one, "b"), two, "a").where(linked("ha", "hb")).select("a", "b")


def _sets_of(reps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, hashes: the full sets of some classes, as a stored table."""
    wanted = table(join_shuffled(classes.select("set_id", "rep", "th"), reps, "rep", "left_semi"), "wanted")
    texts = join_sized(_texts(docs), wanted.select(F.col("rep").alias("doc_id"), "th").distinct(), ["doc_id", "th"])
    sets = _sets(texts).dropDuplicates(["set_id"])
    return table(join_sized(sets, wanted.select("set_id", "rep"), ["set_id"]).select("rep", "hashes"), "sets")


def components(links: DataFrame) -> DataFrame:
    """(label, root) for every label in ``links`` (la, lb): the least label that it reaches.

    Each round hooks every label to its least neighbour, follows those to their roots and contracts the links, so
    that components at least halve; all of it is joins and grouped minima on stored tables.
    """
    links = table(links.where("la <> lb").distinct(), "links")
    roots: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select("lb", "la"))
        up = table(both.groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("m")).select("label", F.least("label", "m").alias("root")), "hooks")
        while True:
            over = up.select(F.col("label").alias("root"), F.col("root").alias("next"))
            jumped = table(join_sized(up, over, ["root"]).select("label", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumps")
            up = jumped.select("label", "root")
            if jumped.where("moved").isEmpty():
                break
        a = up.select(F.col("label").alias("la"), F.col("root").alias("ra"))
        b = up.select(F.col("label").alias("lb"), F.col("root").alias("rb"))
        links = table(join_sized(join_sized(links, a, ["la"]), b, ["lb"]).select(F.col("ra").alias("la"), F.col("rb").alias("lb")).where("la <> lb").distinct(), "links")
        if roots is None:
            roots = up
        else:
            over = up.select(F.col("label").alias("root"), F.col("root").alias("next"))
            roots = table(join_sized(roots, over, ["root"], "left").select("label", F.coalesce("next", "root").alias("root")).unionByName(join_shuffled(up, roots, "label", "left_anti")), "roots")
    return roots if roots is not None else links.select(F.col("la").alias("label"), F.col("lb").alias("root"))


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class _Cell:
    """The rows of a cell as arrays, and for each row which later ones it must be compared with."""

    def __init__(self, cell: list[dict]):
        self.sig = np.frombuffer(b"".join(r["sig"] for r in cell), np.uint8).reshape(len(cell), -1)
        self.bands = np.array([r["bands"] for r in cell], np.int64)
        self.label, self.size = np.array([r["label"] for r in cell]), np.array([r["n_shingles"] for r in cell])
        self.block, self.node = np.array([r["own"] for r in cell]), np.array([r["rep"] for r in cell])
        self.band = int(np.flatnonzero(self.bands[0] == cell[0]["key"])[0])
        self.two, self.free = cell[0]["i"] != cell[0]["j"], self.node != cell[0]["leader"]

    def promising(self, at: int) -> np.ndarray:
        """Later rows of another label, of a size that allows the threshold and an estimate near it.

        The pair's first common band must be this bucket's, neither be the bucket's leader (those pairs were compared
        before), and in a cell of two blocks the blocks differ.
        """
        if not self.free[at]:
            return np.empty(0, np.int64)
        rest = slice(at + 1, None)
        size, own = self.size[rest], self.size[at]
        good = self.free[rest] & (self.label[rest] != self.label[at]) & (100 * np.minimum(size, own) >= PERCENT * np.maximum(size, own))
        if self.two:
            good &= self.block[rest] != self.block[at]
        where = np.flatnonzero(good) + at + 1
        if len(where):
            where = where[estimate(_DIFFERENT[self.sig[where] ^ self.sig[at]].sum(axis=1, dtype=np.int64)) >= LEAST_ESTIMATE]
            where = where[(self.bands[where] == self.bands[at]).argmax(axis=1) == self.band]
        return where


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, label, sig, bands, n_shingles, leader, n, ...) of buckets dealt in blocks to triangular cells, sorted by cell."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("n", "blocks", "other")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    cell: list[dict] = []
    at = None
    for batch in batches:
        for r in batch.to_pylist():
            if (here := (r["key"], r["i"], r["j"])) != at:
                if len(cell) > 1:
                    yield cell
                cell, at = [], here
            cell.append(r)
    if len(cell) > 1:
        yield cell


def _hopeful(rows: DataFrame) -> DataFrame:
    """(key, rep) of the rows that have a promising partner in some cell of their bucket."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("rep", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            some, arrays = np.zeros(len(cell), bool), _Cell(cell)
            for at in range(len(cell)):
                found = arrays.promising(at)
                some[found] = True
                some[at] |= len(found) > 0
            reps = [cell[k]["rep"] for k in np.flatnonzero(some)]
            yield pa.RecordBatch.from_arrays([pa.array([cell[0]["key"]] * len(reps), pa.int64()), pa.array(reps, pa.int64())], names=["key", "rep"])

    return _cells(rows).mapInArrow(run, schema).distinct()


def _links_in_cells(rows: DataFrame) -> DataFrame:
    """Links between rows (with ``hashes``) that full sets confirm; of those within a cell, as many as connect what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            sets, arrays = [np.frombuffer(r["hashes"], np.uint64) for r in cell], _Cell(cell)
            up: dict[int, int] = {}

            def root(x: int, up: dict[int, int] = up) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            a, b = [], []
            for at in range(len(cell)):
                for k in arrays.promising(at).tolist():
                    x, y = root(cell[at]["label"]), root(cell[k]["label"])
                    if x != y and _linked(sets[at], sets[k]):
                        up[max(x, y)] = min(x, y)
                        a.append(cell[at]["rep"])
                        b.append(cell[k]["rep"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=PAIRS.names)

    return _cells(rows).mapInArrow(run, PAIRS).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are not read).

    Null, empty and white texts have no shingles and are linked with nothing. A row whose doc_id is null is in no
    component, and kept. Repeated rows get the same result each. A doc_id with several texts is one document, linked
    where any of its texts is. th is a hash of the text. Ties need no order: a component does not depend on it.
    """
    feats = table(_features(docs), "features")
    some = feats.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")]
    shared = F.min("doc_id") < F.max("doc_id")
    classes = table(some.groupBy("set_id").agg(F.min(F.struct("doc_id", "th")).alias("r"), shared.alias("shared"), *firsts)
                    .select("set_id", F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th"), "shared", "n_shingles", "sig", "bands"), "classes")
    rows = classes.select("rep", F.explode("bands").alias("key"))
    leaders = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = table(join_shuffled(rows, leaders, "key"), "members")  # most buckets have one member, and end here
    sigs = classes.select("rep", "sig")

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    both = join_shuffled(star, sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    both = join_shuffled(both, sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
    near = table(both.where(estimated("sa", "sb") >= LEAST_ESTIMATE).select("a", "b"), "near")
    links = table(_confirm(near, classes, docs).select(F.col("a").alias("la"), F.col("b").alias("lb")), "links")
    roots = table(components(links), "roots")  # of classes that have a link; the others are their own

    own = join_sized(members, roots.withColumnRenamed("label", "rep"), ["rep"], "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
    mixed = table(own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "mixed")
    rest = table(join_sized(own, mixed, ["key"]), "rest")
    wide = join_shuffled(rest, classes.select("rep", "sig", "bands", "n_shingles"), "rep")
    hopeful = table(_hopeful(wide), "hopeful")
    if not hopeful.isEmpty():
        sets = _sets_of(hopeful.select("rep").distinct(), classes, docs)
        left = join_shuffled(join_shuffled(rest.drop("n"), hopeful, ["key", "rep"]), hopeful.groupBy("key").agg(F.count("*").alias("n")), "key")
        more = _links_in_cells(join_shuffled(join_shuffled(left, classes.select("rep", "sig", "bands", "n_shingles"), "rep"), sets, "rep"))
        links = table(links.union(more), "links")
        roots = table(components(links), "roots")

    # a class of one document that nothing links needs no label: the document is its own component
    labelled = join_sized(classes.select("set_id", "rep", "shared"), roots.withColumnRenamed("label", "rep"), ["rep"], "left").where("shared OR root IS NOT NULL")
    labels = table(labelled.select("set_id", F.coalesce("root", "rep").alias("label")), "labels")
    out = join_sized(feats.select("doc_id", "th", "n_shingles", "set_id"), labels, ["set_id"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("label")), F.col("doc_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least doc_id, and of its repeated rows one.

    Of rows that agree in doc_id and text the least in the order of ``docs``' columns stays, nulls first. Rows without a
    doc_id all stay, as do those without words. Columns may have any names: they travel inside ``row``.
    """
    found = near_duplicates(docs).groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.first("kept").alias("kept"))
    odd = table(found.where("NOT kept OR n > 1").withColumnsRenamed({"doc_id": "id"}), "odd")  # most rows are kept as they are
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    left = join_sized(keyed, odd, ["id", "th"], "left").where("kept IS NULL OR kept")
    once = left.where("n IS NULL OR n = 1 OR id IS NULL").select("row")
    again = left.where("n > 1 AND id IS NOT NULL").groupBy("id", "th").agg(F.min("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th")
