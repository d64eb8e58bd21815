"""What SQL can say of the operators' results: the near-duplicates as a whole, of others the columns that no fit decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import media, minhash, pii, quality_rules

TEXT = "coalesce(text, '')"
WORD = r"'[^\x20\x09-\x0D]+'"
LOWER = f"translate({TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rules_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op1_quality_rules and its base verdict."""
    return quality_rules.op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_media reads back from its stored pictures."""
    return media.op2_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op3_pii, counted by kind."""
    return pii.op3_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.KINDS])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (rules_counts, media_payload, pii_base_counts)}


def _rules() -> str:
    covered = "(n3 > 1 OR coalesce(lag(n3) OVER w, 0) > 1 OR coalesce(lag(n3, 2) OVER w, 0) > 1)"
    return f"""
WITH d AS (SELECT doc_id, {TEXT} AS t, regexp_extract_all({TEXT}, {WORD}) AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
g AS (SELECT doc_id, k, CASE WHEN k + 2 <= len(w) THEN count(*) OVER (PARTITION BY doc_id, k + 2 <= len(w), w[k], w[k + 1], w[k + 2]) ELSE 0 END AS n3 FROM u),
r AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n FROM (SELECT doc_id, {covered} AS c FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY k)) GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s"""


def _payload() -> str:
    pad = "CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END"
    return f"""
SELECT doc_id, n AS n_bytes, n + {pad} AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, {pad})) AS payload_sha256
FROM (SELECT doc_id, encode({TEXT}) AS b, CAST(octet_length(encode({TEXT})) AS BIGINT) AS n FROM documents)"""


def _pii() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    found = lambda pattern: f"regexp_extract_all({TEXT}, '{pattern}')"
    figure = f"CAST(substr({digits}, length({digits}) - k + 1, 1) AS INTEGER)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {figure} WHEN {figure} > 4 THEN 2 * {figure} - 9 ELSE 2 * {figure} END)) % 10 = 0"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) <= 255))"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
    }
    counts = [f"CAST(len(list_filter({found(p)}, lambda m: {valid})) AS BIGINT) AS n_{k}" for k, (p, valid) in kinds.items()]
    return f"SELECT doc_id, {', '.join(counts)} FROM documents"


def _minhash() -> str:
    five = " || ' ' || ".join(f"w[i + {k}]" for k in range(minhash.SHINGLE))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {minhash.SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {minhash.SHINGLE - 2}), lambda i: {five}) END) AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {minhash.PERCENT} * (na + nb - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT s.doc_id, CAST(any_value(len(x)) AS BIGINT) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"rules_counts": _rules(), "media_payload": _payload(), "pii_base_counts": _pii(), "op6_minhash": _minhash()}
