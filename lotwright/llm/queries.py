"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query, module of this subpackage.
_OPERATORS = [
    ("op1_best_fit_packing", "packing"),
    ("op2_warc_bundles", "warc"),
    ("op3_substring_dedup", "substring"),
    ("op4_chat_formatting", "chat"),
    ("op5_html_extraction", "html"),
    ("op6_document_fingerprints", "fingerprint"),
    ("op7_simhash_near_dedup", "simhash"),
    ("op8_toxicity", "toxicity"),
    ("op9_line_dedup", "lines"),
    ("op10_decontamination", "decontamination"),
    ("op11_token_files", "tokenfiles"),
    ("op12_cross_tokenizer_alignment", "align"),
    ("op13_embedding_whitening", "whitening"),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in _OPERATORS if (sql := getattr(import_module(f"{__package__}.{module}"), f"{name.split('_')[0].upper()}_SQL", None))}
