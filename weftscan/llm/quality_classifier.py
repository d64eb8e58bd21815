"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, each encoded from its bytes; only documents carry labels. Gated attention
(tanh and sigmoid branches) weighs the encoded passages, and the weighted representation is scored. The network
is small, trained here with numpy on a bounded sample of labelled rows, and applied to whole texts as a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .store import narrow_batches

PASSAGE_BYTES = 384
#: Labelled rows that training uses at most: those of the least hash of their doc_id, so the choice is the same each run.
SAMPLE_ROWS = 4000
HELD_OUT_MOD = 5
THRESHOLD = 0.3
#: Bytes of text that are scored together.
GROUP_BYTES = 1 << 18
HASHED = 48
HIDDEN, ATTENTION = 24, 12
EPOCHS, BAG_BATCH, RATE = 12, 64, 0.01

#: Classes of bytes: lower case, upper case, digits, blanks, line ends, continuation and lead bytes, then marks one by one.
_MARKS = b".,!|%#*$&<>\"'-_=:;()/\\?@+"
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[9:14] = 0, 1, 2, 3, 4
_CLASS[128:] = 5
for _k, _c in enumerate(_MARKS):
    _CLASS[_c] = 7 + _k
CLASSES = 7 + len(_MARKS)
WIDTH = CLASSES + HASHED + 4
_BIG = (np.random.default_rng(7).integers(0, HASHED, 65536)).astype(np.int64)
_PLACE = np.random.default_rng(11).integers(1, 2**62, 64, dtype=np.int64) | 1


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of each text); an empty text has one passage of no bytes."""
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    per = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    total = int(per.sum())
    raw = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    out = np.zeros((total, WIDTH))
    if len(raw):
        first = np.cumsum(per) - per
        start = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(texts)), lengths)
        where = np.arange(len(raw)) - start[doc]
        at = first[doc] + where // PASSAGE_BYTES
        size = np.maximum(1, np.bincount(at, minlength=total))[:, None]
        out[:, :CLASSES] = np.bincount(at * CLASSES + _CLASS[raw], minlength=total * CLASSES).reshape(total, -1) / size
        pair = _BIG[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        inside = doc[1:] == doc[:-1]  # no pair spans two texts, so that a text's score is its own
        out[:, CLASSES : CLASSES + HASHED] = np.bincount((at[:-1] * HASHED + pair)[inside], minlength=total * HASHED).reshape(total, -1) / size
        word = (raw != 32) & ((raw < 9) | (raw > 13))
        begins = word & np.r_[True, ~word[:-1] | (doc[1:] != doc[:-1])]
        edge = np.flatnonzero(begins)
        if len(edge):
            offset = np.arange(len(raw)) - edge[np.maximum(np.cumsum(begins) - 1, 0)]
            h = np.add.reduceat(np.where(word, (raw.astype(np.int64) + 1) * _PLACE[offset & 63], 0), edge)
            owner = at[edge]
            n = np.maximum(1, np.bincount(owner, minlength=total))
            same = np.r_[False, (h[1:] == h[:-1]) & (doc[edge][1:] == doc[edge][:-1])]
            out[:, -4] = np.bincount(owner[same], minlength=total) / n
            distinct = np.unique(h ^ (owner * np.int64(0x9E3779B97F4A7C1)), return_index=True)[1]
            out[:, -3] = np.bincount(owner[distinct], minlength=total) / n
            out[:, -2] = np.minimum(2.0, np.log1p(np.bincount(at[word], minlength=total) / n) / 2)
    out[:, -1] = 1.0
    return out, per


def grouped_passages(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`passages` of some texts at a time, so that memory does not follow their number."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < GROUP_BYTES):
            size += len(texts[stop] or b"")
            stop += 1
        yield passages(texts[at:stop])
        at = stop


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


Model = dict[str, np.ndarray]


def forward(m: Model, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the bags, and what the gradient needs."""
    first = np.cumsum(per) - per
    bag = np.repeat(np.arange(len(per)), per)
    h = np.tanh(x @ m["w"] + m["b"])
    t, g = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    a = (t * g) @ m["a"]
    e = np.exp(a - np.maximum.reduceat(a, first)[bag])
    weight = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(weight[:, None] * h, first)
    return _sigmoid(z @ m["c"] + m["d"]), (first, bag, h, t, g, weight, z)


def gradient(m: Model, x: np.ndarray, p: np.ndarray, y: np.ndarray, kept: tuple) -> Model:
    first, bag, h, t, g, weight, z = kept
    error = (p - y) / len(y)
    dz = error[:, None] * m["c"]
    inner = (dz[bag] * h).sum(axis=1)
    da = weight * (inner - np.add.reduceat(weight * inner, first)[bag])
    dt, dg = da[:, None] * m["a"] * g * (1 - t * t), da[:, None] * m["a"] * t * g * (1 - g)
    dh = weight[:, None] * dz[bag] + dt @ m["v"].T + dg @ m["u"].T
    dx = dh * (1 - h * h)
    return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ da, "c": z.T @ error, "d": error.sum(keepdims=True)}


def train(texts: list[bytes | None], labels: list[int], seed: int = 0) -> Model:
    """Weights from labelled texts, by Adam on the log loss. With one class or no rows the scores are that class's rate."""
    rng = np.random.default_rng(seed)
    m: Model = {"w": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "u": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.2, ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    y = np.array(labels, float)
    rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    m["d"][:] = np.log(rate / (1 - rate))
    m["mean"], m["scale"] = np.zeros(WIDTH), np.ones(WIDTH)
    if len(set(labels)) < 2:
        return m
    found = list(grouped_passages(texts))
    x, per = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    m["mean"], m["scale"] = x.mean(axis=0), np.maximum(x.std(axis=0), 0.01)
    x = np.clip((x - m["mean"]) / m["scale"], -8, 8)
    first = np.cumsum(per) - per
    names = ["w", "b", "v", "u", "a", "c", "d"]
    one, two, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BAG_BATCH):
            bags = order[at : at + BAG_BATCH]
            rows = np.concatenate([np.arange(first[k], first[k] + per[k]) for k in bags])
            p, kept = forward(m, x[rows], per[bags])
            step += 1
            for k, d in gradient(m, x[rows], p, y[bags], kept).items():
                d = d + 1e-4 * m[k]
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.999 * two[k] + 0.001 * d * d
                m[k] = m[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def score_texts(m: Model, texts: list[bytes | None]) -> np.ndarray:
    out = [forward(m, np.clip((x - m["mean"]) / m["scale"], -8, 8), per)[0] for x, per in grouped_passages(texts)]
    return np.concatenate(out) if out else np.empty(0)


def scorer(m: Model) -> Callable[[Column], Column]:
    """A column function from the UTF-8 bytes of a text to its score."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.round(score_texts(m, texts.tolist()), 6), dtype="float64")

    return score


def held_out(doc_id: str | Column = "doc_id", mod: int = HELD_OUT_MOD) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> Model:
    """Train on at most ``sample_rows`` labelled rows that are not held out; unlabelled and null labels are left out.

    Labels are chosen before the join, so no text is shuffled.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("b"))
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "b")).limit(sample_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["b"] or b"", r["quality"]))
    return train([bytes(r["b"]) if r["b"] is not None else None for r in rows], [r["quality"] for r in rows], seed)


def with_scores(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in column ``name``, replacing one of that name.

    Nulls and empty texts are scored as a bag of one empty passage; repeated rows get equal scores; lang, source and
    doc_id are no inputs. An empty table stays empty; without labels every score is 0.5.
    """
    narrow_batches(docs.sparkSession)
    return docs.withColumn(name, scorer(fit(docs, labels))(F.encode(F.col("text").cast("string"), "UTF-8")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is THRESHOLD or more, with their own columns, whatever these are called.

    Nulls, empty texts and repeated rows are scored as :func:`with_scores` says; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))
    return with_scores(rows, labels).where(F.col("score") >= THRESHOLD).select("row.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = with_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
