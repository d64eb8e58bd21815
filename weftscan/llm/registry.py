"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language_model, licences, media, minhash, oracles, packing, pii, quality_classifier, quality_rules, sentence_pieces


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_media": media.op2_media,
        "op3_pii": pii.op3_pii,
        "op4_packing": packing.op4_packing,
        "op5_licences": licences.op5_licences,
        "op6_minhash": minhash.op6_minhash,
        "op7_html_text": html_text.op7_html_text,
        "op8_language_model": language_model.op8_language_model,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_sentence_pieces": sentence_pieces.op10_sentence_pieces,
    } | oracles.queries()


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express; the other results are tested against brute force."""
    return oracles.oracle_sql()
