"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Every whole text gives counts and from them a vector of transformed statistics. For each (lang, source) group,
concentration steps find the 75 % of distinct vectors whose covariance has the least determinant: squared
distances from the current centre, their quantile by group, and the moments of the rows below it, all as grouped
aggregates of the whole table. Three starts are led to convergence, and each group takes the one of least determinant.
Quantiles are read off counts by bin, so of a hot group only bins and moments reach one place. Copies of a vector count once in
the fit, so a group of copies cannot become the centre. Groups that are small lean on their language's pooled
scatter. Rows are rejected by Mahalanobis distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .store import join_sized, narrow_batches, table

#: Documents below this many words, or with more than half of their words in repeated windows, fail the base rule.
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Share of a group that the estimate concentrates on. Concentration steps end when no group's determinant falls by more
#: than the factor exp(SETTLED), or after STEPS.
SUPPORT = 0.75
STEPS, SETTLED = 10, 0.02
#: Starts: whole scatter, squared length, and largest coordinate in scaled deviations from the medians.
STARTS = 3
#: Bins of a quantile: this many for a unit near 0, and for a factor of e far from it.
FINE = 1024
#: The smallest scale of each statistic, so that small changes of one that hardly varies do not reject; large ones can:
#: half of the lines repeated, or half of the words in repeated windows, are beyond the cutoff where others have none.
FLOORS = {"x_words": 0.35, "x_length": 0.35, "x_symbols": 0.6, "x_lines": 0.5, "x_repeats": 0.5, "x_upper": 0.4, "x_digits": 0.6, "x_marks": 0.4, "x_variety": 0.03}
NAMES = list(FLOORS)
#: Chi-squared quantiles for nine statistics: the median, 0.975, and 1 - 1e-4, beyond which a document is rejected.
CHI2_MEDIAN, CHI2_975, CUTOFF = 8.343, 19.023, 33.72
#: Vectors that a group's own scatter is weighed against its language's.
PRIOR_ROWS = 60

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.DoubleType()) for c in NAMES]])

_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b"!\"'(),-./:;?@[\\]^_`{|}~+=<>#*$%&":
    _KIND[_c] = 3


def statistics(text: bytes | None) -> tuple[float, ...]:
    """The counts of a text in UTF-8, then its transformed statistics. A null counts as empty, with all counts 0."""
    data = text or b""
    words = data.split()
    n = len(words)
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=4)
    spaces = int(np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13))))
    chars = len(raw) - int(np.count_nonzero(_CONT[raw])) - spaces
    symbols = sum(map(data.count, (bytes([c]) for c in SYMBOLS)))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    ids_of: dict[bytes, int] = {}
    repeats, distinct = 0, n
    if n:
        ids = np.fromiter((ids_of.setdefault(w, len(ids_of)) for w in words), np.int64, n)
        distinct = len(ids_of)
        if n >= 3:
            if distinct < 1 << 20:
                key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
                _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            else:
                _, inverse, count = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[inverse.ravel()] > 1)
            mark = np.zeros(n, bool)
            for k in range(3):
                mark[at + k] = True
            repeats = int(mark.sum())
    share = lambda part, whole: part / whole if whole else 0.0
    odds = lambda p: float(np.log((p + 0.02) / (1.02 - p)))
    return (
        n, chars, symbols, dup, repeats,
        float(np.log1p(n)), share(chars, n), float(np.arcsinh(30 * share(symbols, n))), 6 * share(dup, lines), 6 * share(repeats, n),
        odds(share(int(kinds[1]), chars)), float(np.arcsinh(30 * share(int(kinds[2]), chars))), odds(share(int(kinds[3]), chars)),
        float(np.log(distinct) / np.log(n)) if n > 1 else 1.0,
    )


@pandas_udf(STATS)
def statistics_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [statistics(x) for x in texts]
    out = pd.DataFrame(rows, columns=STATS.names) if rows else pd.DataFrame({c: [] for c in STATS.names})
    return out.astype({c: "int64" for c in COUNTS} | {c: "float64" for c in NAMES})


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``__s`` of counts and transformed statistics; nothing else changes."""
    narrow_batches(docs.sparkSession)
    counted = statistics_udf.asNondeterministic()  # else a filter on it is pushed below, and it runs once more
    return docs.withColumn("__s", counted(F.encode(F.col("text").cast("string"), "UTF-8")))


def base_failed(s: str = "__s.") -> Column:
    return (F.col(f"{s}n_words") < MIN_WORDS) | (100 * F.col(f"{s}n_repeat_words") > REPEAT_PERCENT * F.col(f"{s}n_words"))


def _distance(names: list[str], centre: str = "m", inverse: str = "inv") -> Column:
    """Squared Mahalanobis distance of the columns from ``centre`` under the row-major ``inverse``."""
    d = [F.col(c) - F.col(centre)[k] for k, c in enumerate(names)]
    total: Column = F.lit(0.0)
    for j in range(len(names)):
        inner: Column = F.lit(0.0)
        for k in range(len(names)):
            inner = inner + F.col(inverse)[j * len(names) + k] * d[k]
        total = total + d[j] * inner
    return total


def _moments(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("n")] + [F.sum(c).alias(f"s_{k}") for k, c in enumerate(names)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"q_{j}_{k}") for j, a in enumerate(names) for k, b in enumerate(names) if k >= j]
    return rows.groupBy(*keys).agg(*aggs)


def _estimates(moments: DataFrame, keys: list[str], names: list[str], floors: list[float]) -> DataFrame:
    """Centre, inverse scatter and its log-determinant for each group, leaning on the language's pooled scatter by PRIOR_ROWS vectors.

    The first key is the language; a key ``start`` keeps the starts apart.
    """
    d = len(names)
    sums = [c for c in moments.columns if c[:2] in ("s_", "q_") or c == "n"]
    within = [f"s_{j}*s_{k}/n" for j in range(d) for k in range(j, d)]
    wider = [keys[0], *[k for k in keys if k == "start"]]
    pool = moments.groupBy(*wider).agg(
        *[F.sum(c).alias(f"p_{c}") for c in sums], *[F.sum(F.expr(w)).alias(f"w_{i}") for i, w in enumerate(within)]
    )
    both = join_sized(moments, table(pool, "pool"), wider)
    number = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[moments.schema[k] for k in keys], T.StructField("m", number), T.StructField("inv", number), T.StructField("logdet", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = [(j, k) for j in range(d) for k in range(j, d)]
        for b in batches:
            out: dict[str, list] = {"m": [], "inv": [], "logdet": []}
            for r in b.to_dict("records"):
                n, pn = r["n"], r["p_n"]
                mean = np.array([r[f"s_{k}"] for k in range(d)]) / n
                pmean = np.array([r[f"p_s_{k}"] for k in range(d)]) / pn
                own, pooled = np.zeros((d, d)), np.zeros((d, d))
                for i, (j, k) in enumerate(upper):
                    own[j, k] = own[k, j] = r[f"q_{j}_{k}"] / n - mean[j] * mean[k]
                    pooled[j, k] = pooled[k, j] = (r[f"p_q_{j}_{k}"] - r[f"w_{i}"]) / pn
                weight = n / (n + PRIOR_ROWS)
                scatter = weight * own + (1 - weight) * pooled + np.diag(np.square(floors))
                out["m"].append((weight * mean + (1 - weight) * pmean).tolist())
                out["inv"].append(np.linalg.inv(scatter).ravel().tolist())
                out["logdet"].append(float(np.linalg.slogdet(scatter)[1]))
            yield pd.DataFrame({**{k: b[k] for k in keys}, **out})

    return both.mapInPandas(run, schema)


def quantile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """``keys`` and ``q``, the upper edge of the bin up to which at least ``share`` of the group's rows lie.

    Rows are counted by bin before a group meets in one task: some ten thousand bins at most, however many rows it has.
    """
    counted = rows.groupBy(*keys, F.floor(F.asinh(value) * FINE).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    upto = counted.select(*keys, "bin", F.sum("c").over(by.orderBy("bin")).alias("upto"), F.sum("c").over(by).alias("total"))
    return upto.where(F.col("upto") >= share * F.col("total")).groupBy(*keys).agg(F.sinh((F.min("bin") + 1) / FINE).alias("q"))


def _each(rows: DataFrame, keys: list[str], values: list[Column], name: str) -> DataFrame:
    """``keys`` and the medians ``name``_0, … of the values, by group."""
    long = rows.select(*keys, F.posexplode(F.array(*values)).alias("k", "v"))
    found = quantile(long, [*keys, "k"], "v", 0.5)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"{name}_{k}") for k in range(len(values))])


def fit(vectors: DataFrame, keys: list[str], names: list[str], floors: list[float]) -> DataFrame:
    """Minimum-covariance-determinant estimates: ``keys``, centre ``m``, inverse scatter ``inv``; one row for each group.

    ``vectors`` holds ``keys`` (nulls form groups of their own) and ``names``. An empty table gives none.
    """
    d = len(names)
    rows = table(vectors.select(*keys, *names).na.drop(subset=names).distinct(), "vectors")
    near = join_sized(rows, table(_each(rows, keys, [F.col(c) for c in names], "m"), "medians"), keys)
    spread = table(_each(near, keys, [F.abs(F.col(c) - F.col(f"m_{k}")) for k, c in enumerate(names)], "a"), "spreads")
    whole = table(_estimates(table(_moments(rows, keys, names), "moments"), keys, names, floors), "whole")
    scaled = join_sized(join_sized(near, spread, keys), whole, keys)
    z = [F.abs(F.col(c) - F.col(f"m_{k}")) / F.greatest(F.col(f"a_{k}") * 1.4826, F.lit(floors[k])) for k, c in enumerate(names)]
    first = [_distance(names), sum((x * x for x in z), F.lit(0.0)), F.greatest(*z) if d > 1 else z[0]]
    begun = scaled.select(*keys, *names, F.posexplode(F.array(*first)).alias("start", "d2"))
    started = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    every = [*keys, "start"]

    def concentrated(measured: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
        core = join_sized(measured, table(cuts, "cuts"), by).where("d2 <= q")
        return table(_estimates(table(_moments(core, by, names), "moments"), by, names, floors), "estimates")

    now = concentrated(begun, quantile(begun, every, "d2", SUPPORT), every)
    for _ in range(STEPS):
        measured = join_sized(started, now, every).withColumn("d2", _distance(names)).select(*every, *names, "d2")
        last, now = now, concentrated(measured, quantile(measured, every, "d2", SUPPORT), every)
        fall = join_sized(now, last.select(*every, F.col("logdet").alias("before")), every).agg(F.max(F.col("before") - F.col("logdet")))
        if (fall.first()[0] or 0.0) <= SETTLED:
            break
    least = now.groupBy(*keys).agg(F.min(F.struct("logdet", "start", "m", "inv")).alias("e")).select(*keys, "e.m", "e.inv")
    # the last step weighs anew by the estimate, made consistent at the median
    measured = join_sized(rows, table(least, "least"), keys).withColumn("d2", _distance(names)).select(*keys, *names, "d2")
    cuts = quantile(measured, keys, "d2", 0.5).withColumn("q", F.greatest(F.col("q") / CHI2_MEDIAN, F.lit(1.0)) * CHI2_975)
    return concentrated(measured, cuts, keys).drop("logdet")


def judged(d: DataFrame, estimates: DataFrame) -> DataFrame:
    joined = join_sized(d, estimates, ["lang", "source"], "left").withColumn("d2", F.coalesce(_distance(NAMES), F.lit(0.0)))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CUTOFF)).drop("m", "inv")


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, d2 and kept for every document.

    Null or empty texts have counts of 0 and fail the base rule; null languages or sources form their own group;
    repeated rows are judged each, and alike. Columns other than doc_id, text, lang and source are not read.
    """
    s = with_statistics(docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string")))
    stats = table(s.withColumn("base_failed", base_failed()).select("doc_id", "lang", "source", "base_failed", "__s.*"), "statistics")
    estimates = fit(stats.where(~F.col("base_failed")), ["lang", "source"], NAMES, list(FLOORS.values()))
    return judged(stats, estimates).select("doc_id", *COUNTS, "base_failed", "kept", "d2")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their own columns, whatever these are called: they travel inside ``row``.

    Decisions are joined by content, not by doc_id, so that repeats and nulls hold. An empty table stays empty.
    """
    s = with_statistics(docs.select(F.struct("*").alias("row"), "text", F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source")))
    flat = s.select("row", "__lang", "__source", "__s").withColumn("__bad", base_failed())
    fitted = table(flat.where(~F.col("__bad")).select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), *[F.col(f"__s.{c}").alias(c) for c in NAMES]), "statistics")
    estimates = fit(fitted, ["lang", "source"], NAMES, list(FLOORS.values())).withColumnsRenamed({"lang": "__lang", "source": "__source", "m": "__m", "inv": "__inv"})
    good = join_sized(flat.where(~F.col("__bad")), estimates, ["__lang", "__source"], "left")
    total = _distance([f"__s.{c}" for c in NAMES], "__m", "__inv")
    return good.where(F.coalesce(total, F.lit(0.0)) <= CUTOFF).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
