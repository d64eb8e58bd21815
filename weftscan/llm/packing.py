"""Sequence packing by non-negative least squares over a histogram of piece lengths.

A document becomes whole windows and one remainder. All remainders are counted in a histogram of at most
``window`` bins, which alone comes to the driver. There, shallow combinations of two or three lengths that fill
a window exactly are enumerated, repeat counts are solved against the histogram by non-negative least squares
and rounded down, and what they leave over is packed greedily, again on the histogram. Rows find their slot by
their rank among the pieces of their length, which needs no shuffle of tokens: each task numbers its own pieces,
and a table of (task, length) counts is summed into bases.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import BATCH_ROWS, join_sized, narrow_batches, table

WINDOW = 1024
END_ID = 0
#: Bytes of token ids in one output batch.
BATCH_BYTES = 8 << 20

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("task", T.LongType()), T.StructField("local_rank", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by tiktoken's merge loop: the same ids, several times faster.

    The vocabulary, its order and its special tokens are read from that file. Returns a function from text to ids.
    What the merge loop's splitting pattern cannot take (runs of many thousand blanks) goes to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    of, special = _byte_of(), {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return made.encode(text, allowed_special="all")
        except ValueError:
            return _exact(path).encode(text, add_special_tokens=False).ids

    return encode


@lru_cache(maxsize=2)
def _exact(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenise(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Pieces of at most ``window`` ids of each whole text and its end id: doc_id, start, length, doc_tokens, ids.

    A null text counts as empty and has the end id alone; a null doc_id stays null; repeated rows are packed each.
    ``task`` and ``local_rank`` number the pieces of one length in one task, for :func:`place`.
    Other columns, whatever their names, are not read. ids are little-endian unsigned 32-bit numbers.
    """
    narrow_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        cols: list[list] = [[] for _ in PIECES]
        size = 0

        def flush() -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=PIECES.names)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    for c, v in zip(cols, (doc, start, n, len(ids), task, int(seen[n]), piece.tobytes()), strict=True):
                        c.append(v)
                    seen[n] += 1
                    size += 4 * n + 64
                    if size > BATCH_BYTES:
                        yield flush()
                        size = 0
        if cols[0]:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """All combinations of one to three of ``lengths`` with the sum ``window``, the best supported triples first."""
    have = np.zeros(window + 1, np.int64)
    have[lengths] = counts
    out: list[tuple[int, ...]] = [(window,)] if have[window] else []
    pairs = [(window - b, b) for b in range(1, window // 2 + 1) if have[b] and have[window - b]]
    triples, weight = [], []
    for c in lengths[lengths <= window // 3]:
        b = np.arange(c, (window - c) // 2 + 1)
        a = window - c - b
        good = (have[b] > 0) & (have[a] > 0)
        triples.append(np.stack([a[good], b[good], np.full(good.sum(), c)], 1))
        weight.append(np.minimum(np.minimum(have[a[good]], have[b[good]]), have[c]))
    if triples:
        triples, weight = np.concatenate(triples), np.concatenate(weight)
        out_t = [tuple(map(int, t)) for t in triples[np.argsort(-weight, kind="stable")]]
    else:
        out_t = []
    return out + pairs + out_t


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 600, tol: float = 1e-3) -> np.ndarray:
    """x >= 0 with least squared error of sum(x * column) against ``target``, by accelerated projected gradients.

    A column holds its lengths, with repeats: at most three, so a gradient is three look-ups for each column.
    """
    if not columns:
        return np.zeros(0)
    none = len(target)  # the place that shorter columns are filled up with
    at = np.full((len(columns), max(map(len, columns))), none)
    for j, c in enumerate(columns):
        at[j, : len(c)] = c
    sums = lambda x: np.bincount(at.ravel(), np.repeat(x, at.shape[1]), none + 1)[:none]
    gradient = lambda r: np.append(r, 0.0)[at].sum(axis=1)
    v, largest = np.ones(len(columns)), 1.0
    for _ in range(30):  # the largest eigenvalue, which bounds the step
        v = gradient(sums(v / np.linalg.norm(v)))
        largest = np.linalg.norm(v)
    step = 1 / (1.05 * largest)
    x = y = np.zeros(len(columns))
    t, scale = 1.0, max(1.0, float(target.max(initial=0)))
    for _ in range(sweeps):
        new = np.maximum(0.0, y + step * gradient(target - sums(y)))
        if (y - new) @ (new - x) > 0:  # the momentum leads away: begin anew
            t = 1.0
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved, y = np.abs(new - x).max(), new + (t - 1) / ahead * (new - x)
        x, t = new, ahead
        if moved < tol * scale * step:
            break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) with repeat counts that use each length exactly as often as it occurs."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((pattern, times))
            for v in pattern:
                left[v] -= times

    columns = combinations(np.flatnonzero(left), left[left > 0], window)
    x = nnls(columns, left)
    for j in np.argsort(-x, kind="stable"):
        times = int(x[j] + 1e-6)
        if not times:
            break
        take(columns[j], min([times, *(int(left[v]) // m for v, m in Counter(columns[j]).items())]))
    while (rest := np.flatnonzero(left)).size:  # the residuals: each sequence takes the longest that still fit
        room, pattern, free = window, [], left.copy()
        for v in rest[::-1]:
            k = min(int(free[v]), room // int(v))
            pattern += [int(v)] * k
            room -= k * int(v)
            if room <= 0:
                break
        need = {v: pattern.count(v) for v in set(pattern)}
        take(tuple(pattern), max(1, min(int(left[v]) // m for v, m in need.items())))
    return out


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to stored pieces (any further columns stay). Empty tables stay empty."""
    counts = table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[r["length"]] = r["n"]
    base = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = table(counts.select("task", "length", F.coalesce(base, F.lit(0)).alias("base")), "bases")
    slots: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}
    used, first = np.zeros(window + 1, np.int64), 0
    for pattern, times in plan(histogram, window):
        at: dict[int, list[int]] = {}
        offset = 0
        for v in pattern:
            at.setdefault(v, []).append(offset)
            offset += v
        for v, offsets in at.items():
            slots.setdefault(v, []).append((int(used[v]), first, len(offsets), tuple(offsets)))
            used[v] += times * len(offsets)
        first += times
    columns = pieces.columns
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {v: np.array([s[0] for s in own]) for v, own in slots.items()}
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("local_rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k, (v, r) in enumerate(zip(length.tolist(), rank.tolist(), strict=True)):
                begin, first_id, per, offsets = slots[v][np.searchsorted(starts[v], r, "right") - 1]
                sequence[k], offset[k] = first_id + (r - begin) // per, offsets[(r - begin) % per]
            kept = [batch.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    joined = join_sized(pieces, bases, ["task", "length"])
    return joined.select(*columns, "base").mapInArrow(run, schema)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Pack whole documents into sequences: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``docs`` needs doc_id and text; see :func:`tokenise` for nulls, empty texts and repeated rows.
    """
    return place(table(tokenise(docs, window, vocabulary), "pieces"), window).drop("task", "local_rank")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every document, with the digest of its ids; ids themselves are dropped before they are stored."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digests(docs: DataFrame) -> DataFrame:
    pieces = tokenise(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = place(table(pieces, "pieces"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: one row for each piece of each document that is left, with its ids.

    Of ``docs`` only doc_id and text are read, whatever other columns are called. A null text counts as empty and
    gives one piece of the end id; a null doc_id stays null; repeated rows are packed each; no rows give no rows.
    """
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))
