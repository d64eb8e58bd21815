"""Language-model scores from an Elias-Fano n-gram trie, sharded so that no task holds more than its part.

Texts are tokenised once into chunks of some million tokens, which are stored. A chunk asks the shards for what it
holds: its distinct words, and its distinct (context, successor) pairs, each with its count in training documents.
A word's shard follows from its hash, a pair's from its context and a few bits of its successor, so that the many
successors of a frequent context are spread. A shard merges the counts of all chunks into its trie and answers every
request from it: one shuffle carries counts and questions alike, already aggregated, as sorted arrays.

The trie has a level of words and a level of contexts with successors. Contexts and words are monotone sequences of
hashes in Elias-Fano form; pointers into the successors, and running counts, are monotone too and stored likewise.
Successors are 32-bit hashes, sorted within their context and searched relative to it; beside each stands an 8-bit
code of its smoothed logarithm. Levels lie in one file of the task's own, which is mapped and deleted with the task.

The model is P(w | c) = (n(c, w) + M * P(w)) / (n(c) + M) with P(w) = (n(w) + 1) / (N + V + 1), whose logarithm is
quantised; it sums to one over the words and one unknown word before quantisation.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import narrow_batches, table

CHUNK_TOKENS = 1_000_000
#: Tokens for which there is one shard; the number of shards is a power of two.
SHARD_TOKENS = 2_000_000
HELD_OUT_MOD, HELD_OUT_REST = 7, 2
#: Weight of the word distribution in a context.
M = 100.0
#: Steps of a code in a factor of ten; steps of the quantised word probability.
CODE_STEPS, WORD_STEPS = 24, 512

_U = np.uint64
_START = xxhash.xxh3_64_intdigest(b" start")  # no word holds a blank


class EliasFano:
    """A monotone sequence of numbers below ``top`` in about 2 + log2(top / n) bits each."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.low_bits, self.n, self.low, self.high, self.zeros = low_bits, n, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(1, _U), np.zeros(1, _U), np.zeros(1, np.int64))
        bits = max(0, int(top // max(1, n)).bit_length() - 1)
        values = values.astype(_U)
        upper = (values >> _U(bits)).astype(np.int64)
        flags = np.zeros(-(-(n + int(top >> bits) + 2) // 64) * 64, np.uint8)
        flags[upper + np.arange(n)] = 1
        low = np.zeros((n * bits + 63) // 64 + 1, _U)
        if bits:
            part = values & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        packed = np.packbits(flags, bitorder="little").view(_U)
        zeros = np.r_[0, np.cumsum(64 - flags.reshape(-1, 64).sum(axis=1, dtype=np.int64))]
        return cls(bits, n, low, packed, zeros)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        out = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & _U((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        before = np.arange(len(self.zeros)) * 64 - self.zeros if ones else self.zeros
        block = np.searchsorted(before, k, "right") - 1
        words = self.high[np.minimum(block, len(self.high) - 1)]
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), 1 << 16):
            part = slice(at, at + (1 << 16))
            bits = np.unpackbits(words[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            run = np.cumsum(bits if ones else 1 - bits, axis=1, dtype=np.int16)
            out[part] = np.argmax(run == (k[part] - before[block[part]] + 1)[:, None], axis=1)
        return block * 64 + out

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(_U) << _U(self.low_bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each value, or -1 where it is absent."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        high = (x >> _U(self.low_bits)).astype(np.int64)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        stop = self._select(high, False) - high
        low = x & _U((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(x), _U)
        out = np.full(len(x), -1, np.int64)
        open_ = np.flatnonzero(begin < stop)
        while len(open_):
            here = self.lows(begin[open_])
            out[open_[here == low[open_]]] = begin[open_[here == low[open_]]]
            open_ = open_[here < low[open_]]
            begin[open_] += 1
            open_ = open_[begin[open_] < stop[open_]]
        return out


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in one mapped file that is deleted once they are gone."""
    with tempfile.TemporaryFile() as file:
        starts = []
        for a in arrays:
            starts.append(file.tell())
            file.write(a.tobytes())
            file.write(bytes(-file.tell() % 8 or 8))
        file.flush()
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(view, a.dtype, len(a), s) for a, s in zip(arrays, starts, strict=True)]


class Words:
    """The trie's first level: words by hash, with exact counts as differences of a monotone sequence."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.total, self.n = int(counts.sum()), len(hashes)
        keys, sums = EliasFano.build(hashes, 1 << 64), EliasFano.build(np.r_[0, np.cumsum(counts)], self.total + 1)
        views = mapped(keys.parts() + sums.parts())
        keys.low, keys.high, keys.zeros, sums.low, sums.high, sums.zeros = views
        self.keys, self.sums = keys, sums

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        at = self.keys.find(hashes)
        out = np.zeros(len(hashes), np.int64)
        seen = at >= 0
        out[seen] = (self.sums.get(at[seen] + 1) - self.sums.get(at[seen])).astype(np.int64)
        return out


class Successors:
    """The trie's second level: contexts, pointers, and in each context's range its successors with their codes."""

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray):
        """Entries sorted by context, then successor."""
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.empty(0, np.int64)
        keys = EliasFano.build(contexts[first], 1 << 64)
        pointers = EliasFano.build(np.r_[first, len(contexts)], len(contexts) + 1)
        codes = np.minimum(255, 1 + np.rint(np.log10(np.maximum(counts, 1)) * CODE_STEPS)).astype(np.uint8)
        views = mapped([*keys.parts(), *pointers.parts(), successors.astype(np.uint32), codes])
        keys.low, keys.high, keys.zeros, pointers.low, pointers.high, pointers.zeros, self.words, self.codes = views
        self.keys, self.pointers = keys, pointers

    def lookup(self, contexts: np.ndarray, runs: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of successors, ``runs`` of them for each context; 0 where a pair is not in the trie."""
        node = self.keys.find(contexts)
        seen = node >= 0
        low, high = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        low[seen], high[seen] = self.pointers.get(node[seen]).astype(np.int64), self.pointers.get(node[seen] + 1).astype(np.int64)
        low, high = np.repeat(low, runs), np.repeat(high, runs)
        stop = high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            less = self.words[mid] < successors[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        out = np.zeros(len(successors), np.uint8)
        inside = np.flatnonzero(low < stop)
        hit = inside[self.words[low[inside]] == successors[inside]]
        out[hit] = self.codes[low[hit]]
        return out


CHUNKS = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_train", T.LongType()),
    T.StructField("held", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
])


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_MOD == HELD_OUT_REST


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents as arrays: the sorted hashes of a chunk's words, and its tokens as places among them, three bytes each."""
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            if len(words) >= 1 << 24:
                raise ValueError("a chunk of more than 16 million distinct words")
            packed = tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
            held = np.array([is_held_out(k) for k in ids], np.uint8)
            lengths = np.array([len(p) for p in parts], np.uint32).tobytes()
            row = {"chunk": (task << 24) + made, "doc_ids": list(ids), "n_tokens": len(tokens), "n_train": int((held == 0).sum()), "held": held.tobytes(), "lengths": lengths, "words": words.tobytes(), "tokens": packed}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_train", pa.int64()), *[(c, pa.binary()) for c in ("held", "lengths", "words", "tokens")]])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or b"").lower().split()
                words.append(b" end")  # no word holds a blank
                ids.append(doc)
                parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    made, size = made + 1, 0
                    ids.clear()
                    parts.clear()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8")).mapInArrow(run, CHUNKS)


def _arrays(row: dict) -> dict[str, np.ndarray]:
    """A stored chunk's words, tokens, lengths and held-out flags; of each token its document, and of each pair its context."""
    raw = np.frombuffer(row["tokens"], np.uint8).reshape(-1, 3)
    tokens = np.zeros((len(raw), 4), np.uint8)
    tokens[:, :3] = raw
    tokens = tokens.view("<u4").ravel().astype(np.int64)
    lengths, words = np.frombuffer(row["lengths"], np.uint32).astype(np.int64), np.frombuffer(row["words"], _U)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    context = np.r_[0, tokens[:-1]] if len(tokens) else tokens
    context[first] = len(words)  # the start
    return {"words": words, "tokens": tokens, "doc": doc, "context": context, "train": (np.frombuffer(row["held"], np.uint8) == 0)[doc], "lengths": lengths}


def _pairs(a: dict[str, np.ndarray], shard_bits: int) -> dict[str, np.ndarray]:
    """The distinct (context, successor) pairs of a chunk in the order of requests, and each token's place among them."""
    hashes = np.r_[a["words"], _U(_START)]
    key, place = np.unique((a["context"] << 24) | a["tokens"], return_inverse=True)
    context, successor = hashes[key >> 24], (hashes[key & ((1 << 24) - 1)] >> _U(32)).astype(np.uint32)
    salt_bits = max(0, shard_bits - 3)
    salted = (context ^ (successor.astype(_U) >> _U(32 - salt_bits) if salt_bits else _U(0))) * _U(0x9E3779B97F4A7C15)
    shard = ((salted ^ (salted >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - shard_bits)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint32), kind="stable")  # keys are sorted: by context, then successor
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    counts = np.bincount(place[a["train"]], minlength=len(key))
    return {"shard": shard[order], "context": context[order], "successor": successor[order], "count": counts[order].astype(np.uint32), "place": rank[place]}


ASK = T.StructType([T.StructField("shard", T.LongType()), T.StructField("chunk", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "runs", "more", "counts")]])
REPLY = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("total", T.LongType()), T.StructField("distinct", T.LongType()), T.StructField("found", T.BinaryType())])


def _ask(chunks: DataFrame, shard_bits: int) -> DataFrame:
    """Requests of every chunk to word shards (numbered from 0) and pair shards (from 2 ** shard_bits)."""
    arrow = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("keys", "runs", "more", "counts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, out = _arrays(row), []
                counts = np.bincount(a["tokens"][a["train"]], minlength=len(a["words"])).astype(np.uint32)
                shard = (a["words"] >> _U(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(a["words"]), np.int64)
                for k in np.unique(shard):
                    own = slice(*np.searchsorted(shard, [k, k + 1]))
                    out.append({"shard": int(k), "chunk": row["chunk"], "keys": a["words"][own].tobytes(), "runs": b"", "more": b"", "counts": counts[own].tobytes()})
                p = _pairs(a, shard_bits)
                for k in np.unique(p["shard"]):
                    own = slice(*np.searchsorted(p["shard"], [k, k + 1]))
                    context = p["context"][own]
                    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                    runs = np.diff(np.r_[first, len(context)]).astype(np.uint32)
                    out.append({"shard": (1 << shard_bits) + int(k), "chunk": row["chunk"], "keys": context[first].tobytes(), "runs": runs.tobytes(), "more": p["successor"][own].tobytes(), "counts": p["count"][own].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return chunks.mapInArrow(run, ASK)


def _answer(shard_bits: int):
    """A shard's answers. What several chunks ask is looked up once, so that a chunk costs a shard its share of sorting alone."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("chunk")
        keys = [np.frombuffer(x, _U) for x in asked["keys"]]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in asked["counts"]]).astype(np.int64)
        total = distinct = 0
        if asked["shard"].iloc[0] < 1 << shard_bits:
            words, place = np.unique(np.concatenate(keys), return_inverse=True)
            summed = np.bincount(place, counts, len(words)).astype(np.int64)
            level = Words(words[summed > 0], summed[summed > 0])
            total, distinct = level.total, level.n
            found, sizes = level.counts(words)[place], [len(k) for k in keys]
        else:
            runs = [np.frombuffer(x, np.uint32).astype(np.int64) for x in asked["runs"]]
            more = [np.frombuffer(x, np.uint32) for x in asked["more"]]
            contexts, place = np.unique(np.concatenate(keys), return_inverse=True)
            pair = (np.repeat(place, np.concatenate(runs)).astype(_U) << _U(32)) | np.concatenate(more).astype(_U)
            pair, place = np.unique(pair, return_inverse=True)
            summed = np.bincount(place, counts, len(pair)).astype(np.int64)
            node, successor, seen = (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.uint32), summed > 0
            level = Successors(contexts[node[seen]], successor[seen], summed[seen])
            found, sizes = level.lookup(contexts, np.bincount(node, minlength=len(contexts)), successor)[place], [len(m) for m in more]
        parts = [x.tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"chunk": asked["chunk"], "shard": asked["shard"], "total": total, "distinct": distinct, "found": parts})

    return run


SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def _finish(shard_bits: int, total: int, distinct: int, train_docs: int):
    def run(chunks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        replies = replies.sort_values("shard")
        words = replies["shard"] < 1 << shard_bits
        out = []
        for row in chunks.to_dict("records"):
            a = _arrays(row)
            counts = np.frombuffer(b"".join(replies["found"][words]), np.int64)
            codes = np.frombuffer(b"".join(replies["found"][~words]), np.uint8)
            docs = len(a["lengths"])
            log1 = np.log10((counts + 1) / (total + distinct + 1))
            base = np.bincount(a["doc"], log1[a["tokens"]], docs)
            code = codes[_pairs(a, shard_bits)["place"]].astype(np.float64)
            seen = np.where(code > 0, 10 ** ((code - 1) / CODE_STEPS), 0.0)
            word = 10 ** (np.rint(log1 * WORD_STEPS) / WORD_STEPS)
            context = np.r_[counts, train_docs][a["context"]]
            p = np.minimum(1.0, (seen + M * word[a["tokens"]]) / (context + M))
            known = np.bincount(a["doc"], counts[a["tokens"]] > 0, docs)
            out.append(pd.DataFrame({
                "doc_id": pd.array([None if k is None or k != k else int(k) for k in row["doc_ids"]], "Int64"), "held_out": np.frombuffer(row["held"], np.uint8) > 0,
                "n_tokens": a["lengths"], "n_known": known.astype(np.int64), "train_tokens": total, "base_score": base, "score": np.bincount(a["doc"], np.log10(p), docs),
            }))
        return pd.concat(out)

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    Null and empty texts are an end token alone. A row whose doc_id is null is used for training. Repeated rows count,
    and are scored, each. An empty table gives no rows.
    """
    chunks = table(_chunks(docs), "chunks")
    tokens, train_docs = (int(x or 0) for x in chunks.agg(F.sum("n_tokens"), F.sum("n_train")).first())
    shard_bits = max(3, int(tokens // SHARD_TOKENS).bit_length())
    asked = _ask(chunks, shard_bits).repartition(max(8, 2 << shard_bits), "shard")
    replies = table(asked.groupBy("shard").applyInPandas(_answer(shard_bits), REPLY), "replies")
    whole = replies.where(F.col("shard") < 1 << shard_bits).groupBy("shard").agg(F.first("total").alias("t"), F.first("distinct").alias("d")).agg(F.sum("t"), F.sum("d")).first()
    finish = _finish(shard_bits, int(whole[0] or 0), int(whole[1] or 0), train_docs)
    return chunks.groupBy("chunk").cogroup(replies.select("chunk", "shard", "found").groupBy("chunk")).applyInPandas(finish, SCORES)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
