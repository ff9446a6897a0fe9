"""The queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, decontam, langid, mixing, neardup, oracles, pii, records, resample, sharding, simhash, substring, templates, topk

_QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    sharding.op4_hilbert_sharding,
    records.op6_token_records,
    langid.op7_language_id,
    mixing.op8_soft_mixing,
    templates.op9_line_templates,
    pii.op3_personal_data,
    topk.op5_pivot_topk,
    neardup.op2_circulant_minhash,
    substring.op1_fm_substring,
    decontam.op10_winnowing,
    align.op11_byte_owner_alignment,
    resample.op12_word_trie_resampling,
    simhash.op13_covering_simhash,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
