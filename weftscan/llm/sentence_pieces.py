"""SentencePiece encoding with seeded merge-dropout, and decoding, without loss.

Texts are encoded by the merges of a public BPE model. With a dropout above 0 every candidate merge that comes up on
the agenda is skipped if a hash keyed by the seed, the text, the word's place in it, the place in the word and the merge
says so. The same text always gives the same segmentation, and each occurrence of a word has draws of its own.

What a word does between two skips depends on the word and the skips before alone. Such chains of candidates are found
once and remembered; an occurrence draws for all candidates of its chain at once, and its first skip leads on to the
next chain. So draws are never shared, only the work between them. What comes up for the first time is merged by itself.

Nothing is normalised: blanks become the model's word mark, and a mark, or a character outside the vocabulary, is spelt
in bytes, so decoding gives back every text exactly. Short words are merged in numpy, many at a time; long ones by a heap.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import narrow_batches

MARK = "▁"
DROPOUT, SEED = 0.1, 17
#: Characters up to which words are merged in numpy, chains that a task remembers, and words drawn for at once.
SHORT, CACHE, AT_ONCE = 24, 300_000, 200_000
_PLACE, _PIECE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_FULL = (1 << 64) - 1
_WORD = re.compile(r" *[^ ]+| +")
_NONE = np.iinfo(np.int32).max
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Pieces:
    """A BPE model: its pieces, and for each pair that may merge the merged piece; lower ranks merge first."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(k) for k in range(n)]
        plain = [not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) for k in range(n)]
        self.of = {t: k for k, t in enumerate(self.text) if plain[k]}
        self.byte = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        for k, t in enumerate(self.text):
            if model.is_byte(k):
                self.byte[int(t[3:5], 16)] = k
                self.raw.append(bytes([int(t[3:5], 16)]))
            else:
                self.raw.append(t.replace(MARK, " ").encode() if plain[k] else b"")
        ordered = sorted((k for k in range(n) if plain[k]), key=lambda k: (-model.get_score(k), k))
        rank = {k: r for r, k in enumerate(ordered)}
        pairs = {}
        for t, k in self.of.items():
            for cut in range(1, len(t)):
                a, b = self.of.get(t[:cut]), self.of.get(t[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = (rank[k] << 20) | k
        #: Ids of single characters by code point: a blank is the mark, a mark itself is not in the vocabulary.
        self.single = np.full(0x110000, -1, np.int32)
        for t, k in self.of.items():
            if len(t) == 1:
                self.single[ord(" " if t == MARK else t)] = k
        self.single[ord(MARK)] = -1
        if MARK not in self.of:
            self.single[32] = -1
        self.merge = pairs
        self.piece_of = np.array(ordered, np.int64)
        self._hash(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter((v >> 20 for v in pairs.values()), np.int32, len(pairs)))

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A table of open addresses from pairs to ranks; an empty slot has the key -1."""
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.slots, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]  # of several for a slot one stays
            done = self.slots[at] == keys[left]
            self.ranks[at[done]] = ranks[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or _NONE; ids below 0 never merge."""
        keys = (a.astype(np.int64) << 20) | b
        out = np.full(keys.shape, _NONE, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        keys, flat = keys.ravel(), out.ravel()
        at = self._slot(keys[left])
        while len(left):
            found = self.slots[at]
            hit = found == keys[left]
            flat[left[hit]] = self.ranks[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _limit(dropout: float) -> int:
    return int(dropout * 2**53)


def skipped(key: int, place: int, piece: int, dropout: float) -> bool:
    """Whether the occurrence ``key`` skips its candidate merge into ``piece`` that begins at character ``place``."""
    x = (key + place * _PLACE + piece * _PIECE) & _FULL
    x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & _FULL
    x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) & _FULL
    return (x ^ (x >> 33)) >> 11 < _limit(dropout)


def _spell(p: Pieces, ids: list[int], chars: str) -> bytes:
    """Ids as bytes, with each -1 spelt out; ``chars`` has the characters that the ids of -1 stand for, in order."""
    if chars:
        out, k = [], 0
        for i in ids:
            if i < 0:
                out += p.byte[list(chars[k].encode())].tolist()
                k += 1
            else:
                out.append(i)
        ids = out
    return np.array(ids, np.int32).tobytes()


def _initial(p: Pieces, text: str) -> np.ndarray:
    """Ids of single characters, -1 for those outside the vocabulary."""
    return p.single[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def encode_long(p: Pieces, word: str, key: int, dropout: float) -> bytes:
    """One word by an agenda of candidate merges, best rank first, then leftmost."""
    first = _initial(p, word)
    ids = first.tolist()
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int]] = []

    def push(a: int) -> None:
        b = after[a]
        if b >= 0 and ids[a] >= 0 and ids[b] >= 0:
            found = p.merge.get((ids[a] << 20) | ids[b])
            if found is not None:
                heapq.heappush(heap, (found >> 20, a, ids[a], ids[b]))

    for k in range(n - 1):
        push(k)
    dead = [False] * n
    while heap:
        rank, a, x, y = heapq.heappop(heap)
        b = after[a]
        if dead[a] or b < 0 or ids[a] != x or ids[b] != y:
            continue
        piece = p.merge[(x << 20) | y] & 0xFFFFF
        if dropout > 0 and skipped(key, a, piece, dropout):
            continue
        ids[a], dead[b] = piece, True
        after[a] = after[b]
        if after[a] >= 0:
            before[after[a]] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    left = [i for i, d in zip(ids, dead, strict=True) if not d]
    return _spell(p, left, "".join(c for c, k in zip(word, first.tolist(), strict=True) if k < 0))


def encode_short(
    p: Pieces, words: list[str], skips: list[tuple[int, ...]] | None = None, keys: np.ndarray | None = None, dropout: float = 0.0
) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of at most SHORT characters together: in each turn every word makes or skips its best candidate.

    It skips in the turns that ``skips`` names, or as its key draws. Besides the ids come the candidates met: the row of
    each, its turn, and its place and piece folded into one number.
    """
    first = _initial(p, "".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    named = [(k, turn) for k, s in enumerate(skips or ()) for turn in s]
    forced = np.zeros((len(words), 1 + max((turn for _, turn in named), default=-1)), bool)
    if named:
        forced[tuple(np.array(named).T)] = True
    whole = np.full((len(words), width + 1), -2, np.int32)  # -2: none, or merged into its left neighbour
    whole[:, :width][np.arange(width) < sizes[:, None]] = first
    live, ids = np.arange(len(words)), whole.copy()
    after = np.tile(np.arange(1, width + 2), (len(words), 1))
    after[:, -1] = width
    before = np.tile(np.arange(-1, width), (len(words), 1))
    best = p.pair(ids[:, :-1], ids[:, 1:])
    rows, turns, salts = [], [], []
    turn = 0
    while len(live):
        at = best.argmin(axis=1)
        row = np.arange(len(live))
        rank = best[row, at]
        on = rank != _NONE
        if 2 * int(on.sum()) <= len(live):  # half of the words are done: go on with the others alone
            whole[live[~on]] = ids[~on]
            live, ids, after, before, best, at, rank = live[on], ids[on], after[on], before[on], best[on], at[on], rank[on]
            row = np.arange(len(live))
        else:
            row, at, rank = row[on], at[on], rank[on]
        piece = p.piece_of[rank]
        salt = at.astype(_U) * _U(_PLACE) + piece.astype(_U) * _U(_PIECE)
        if keys is not None:
            skip = (_mixed(keys[live[row]] + salt) >> _U(11)) < _U(_limit(dropout))
        else:
            rows.append(live[row])
            turns.append(np.full(len(row), turn))
            salts.append(salt)
            skip = forced[live[row], turn] if turn < forced.shape[1] else np.zeros(len(row), bool)
        turn += 1
        best[row[skip], at[skip]] = _NONE
        r, c, piece = row[~skip], at[~skip], piece[~skip]
        gone = after[r, c]
        right = after[r, gone]
        ids[r, c], ids[r, gone] = piece, -2
        after[r, c], before[r, right] = right, c
        best[r, np.minimum(gone, width - 1)] = _NONE
        best[r, c] = p.pair(piece, ids[r, right])
        left = before[r, c]
        inner = left >= 0
        best[r[inner], left[inner]] = p.pair(ids[r[inner], left[inner]], piece[inner])
    kept = whole != -2
    raw, ends = whole[kept].tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
    out = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    for i in np.unique(np.repeat(np.arange(len(words)), sizes)[first < 0]).tolist():
        chars = "".join(c for c, k in zip(words[i], _initial(p, words[i]).tolist(), strict=True) if k < 0)
        out[i] = _spell(p, np.frombuffer(out[i], np.int32).tolist(), chars)
    if keys is not None:
        return out, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return out, row[order], np.concatenate(turns)[order], np.concatenate(salts)[order]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(end, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : end] = values
        self.n = end


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Chains:
    """What words do from one skip to the next: a tree for each word, whose edges are the candidates that may be skipped."""

    def __init__(self, p: Pieces, dropout: float):
        self.p, self.dropout = p, dropout
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}  # -1: seen once, without a chain
        self.of: list[tuple[str, tuple[int, ...]]] = []  # the word and the turns skipped
        self.first, self.size = Grown(np.int64), Grown(np.int64)  # a chain's candidates after its last skip
        self.salt, self.child, self.owner = Grown(_U), Grown(np.int64), Grown(np.int64)
        self.ids, self.ids_first, self.ids_size = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def add(self, of: list[tuple[str, tuple[int, ...]]]) -> np.ndarray:
        """The numbers of new chains."""
        order = sorted(range(len(of)), key=lambda k: len(of[k][0]))
        out = np.empty(len(of), np.int64)
        for start in range(0, len(order), 8000):
            part = order[start : start + 8000]
            some = [of[k] for k in part]
            ids, row, turn, salt = encode_short(self.p, [w for w, _ in some], [s for _, s in some])
            later = turn > np.array([s[-1] if s else -1 for _, s in some])[row]
            row, salt = row[later], salt[later]
            size = np.bincount(row, minlength=len(some))
            chain = len(self.of) + np.arange(len(some))
            self.first.extend(self.salt.n + np.cumsum(size) - size)
            self.size.extend(size)
            self.salt.extend(salt)
            self.child.extend(np.full(len(salt), -2))  # -1: taken once, and not followed
            self.owner.extend(chain[row])
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            self.ids_first.extend(self.ids.n + np.cumsum(sizes) - sizes)
            self.ids_size.extend(sizes)
            self.ids.extend(np.frombuffer(b"".join(ids), np.int32))
            self.of += some
            out[part] = chain
        return out

    def walk(self, words: list[str], keys: np.ndarray) -> np.ndarray:
        """The last chain of each occurrence, or -1 for one to be merged by itself; ``keys`` are their keys."""
        counts = Counter(words)
        found = dict.fromkeys(counts, -1) | {w: self.root[w] for w in counts.keys() & self.root.keys()}
        new = [w for w, k in found.items() if k < 0 and (counts[w] > 1 or w in self.root)]
        found.update(zip(new, self.add([(w, ()) for w in new]).tolist(), strict=True))
        self.root.update(found)
        chain = np.fromiter(map(found.__getitem__, words), np.int64, len(words))
        on = np.flatnonzero(chain >= 0) if self.dropout > 0 else np.zeros(0, np.int64)
        while len(on):
            size = self.size.data[chain[on]]
            at = _ranges(self.first.data[chain[on]], size)
            drawn = _mixed(np.repeat(keys[on], size) + self.salt.data[at])
            hit = np.flatnonzero((drawn >> _U(11)) < _U(_limit(self.dropout)))
            row = np.repeat(np.arange(len(on)), size)[hit]
            leads = np.ones(len(row), bool)
            leads[1:] = row[1:] != row[:-1]
            on, edge = on[row[leads]], at[hit[leads]]
            new, n = np.unique(edge[self.child.data[edge] < 0], return_counts=True)
            once = (n == 1) & (self.child.data[new] == -2)
            self.child.data[new[once]] = -1
            lack = new[~once]
            if len(lack):
                made = []
                for e, c in zip(lack.tolist(), self.owner.data[lack].tolist(), strict=True):
                    word, turns = self.of[c]
                    made.append((word, (*turns, (turns[-1] + 1 if turns else 0) + e - int(self.first.data[c]))))
                self.child.data[lack] = self.add(made)
            chain[on] = self.child.data[edge]
            on = on[chain[on] >= 0]
        return chain


def keys_of(text: str, n: int, seed: int) -> np.ndarray:
    """The keys of the ``n`` words of a text."""
    return _mixed(_U(xxhash.xxh3_64_intdigest(text.encode(), seed)) + np.arange(1, n + 1, dtype=_U) * _U(_PLACE))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(" " + text) if text else []


def encode_texts(chains: Chains, texts: list[str | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where those of each end; none for None."""
    p, dropout = chains.p, chains.dropout
    flat, keys, counts = [], [], []
    for t in texts:
        words = words_of(t)
        flat += words
        counts.append(len(words))
        if words:
            keys.append(keys_of(t, len(words), seed))
    key = np.concatenate(keys) if keys else np.zeros(0, _U)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    values, lengths = [], np.zeros(len(flat), np.int64)
    for start in range(0, len(flat), AT_ONCE):
        if len(chains.of) > CACHE or len(chains.root) > 2 * CACHE:
            chains.clear()
        part = slice(start, start + AT_ONCE)
        short = np.flatnonzero(sizes[part] <= SHORT) + start
        last = chains.walk([flat[k] for k in short.tolist()], key[short])
        alone, short, last = short[last < 0], short[last >= 0], last[last >= 0]
        begin, n = np.zeros(len(sizes[part]), np.int64), np.zeros(len(sizes[part]), np.int64)
        begin[short - start], n[short - start] = chains.ids_first.data[last], chains.ids_size.data[last]
        ids, extra = chains.ids.data[: chains.ids.n], []
        size = len(ids)
        alone = alone[np.argsort(sizes[alone], kind="stable")]
        for some in np.array_split(alone, 1 + len(alone) // 8000) if len(alone) else []:
            made = encode_short(p, [flat[k] for k in some.tolist()], keys=key[some], dropout=dropout)[0]
            n[some - start] = [len(x) // 4 for x in made]
            begin[some - start] = size + np.cumsum(n[some - start]) - n[some - start]
            extra.append(np.frombuffer(b"".join(made), np.int32))
            size += len(extra[-1])
        for k in (np.flatnonzero(sizes[part] > SHORT) + start).tolist():
            extra.append(np.frombuffer(encode_long(p, flat[k], int(key[k]), dropout), np.int32))
            begin[k - start], n[k - start] = size, len(extra[-1])
            size += len(extra[-1])
        values.append((np.concatenate([ids, *extra]) if extra else ids)[_ranges(begin, n)])
        lengths[part] = n
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts, dtype=np.int64)] if counts else np.zeros(0, np.int64)
    return (np.concatenate(values) if values else np.zeros(0, np.int32)), ends


def decode_ids(p: Pieces, ids: np.ndarray) -> str:
    raw = p.raw
    return b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None, name: str = "ids") -> DataFrame:
    """``docs`` (with a column text) and ``name``, an array of piece ids; a column of that name is replaced.

    Null texts give null, empty ones no ids; equal texts get equal ids.
    """
    narrow_batches(docs.sparkSession)
    path = model or default_model()
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema, T.StructField(name, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains(pieces(path), dropout)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            values, ends = encode_texts(chains, texts, seed)
            null = pa.array([t is None for t in texts]) if None in texts else None
            ids = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(values), mask=null)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", name: str = "decoded", model: str | None = None) -> DataFrame:
    """``encoded`` and ``name``, the text of its piece ids; null ids give null, no ids the empty text."""
    path = model or default_model()
    encoded = encoded.drop(name)
    schema = T.StructType([*encoded.schema, T.StructField(name, T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            column = batch.column(at)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [decode_ids(p, values[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded with dropout and decoded again: counts and digests of what came out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = decode(encode(docs))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), F.equal_null("decoded", "text").alias("lossless"),
    )
