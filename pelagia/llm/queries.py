"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pelagia.llm import bpe, centroids, katz, language_id, packing, pii, quality_rules, setjoin, simhash, spelling, topk, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_katz_scoring": katz.op3,
    "op4_language_id": language_id.op4,
    "op5_topk_search": topk.op5,
    "op6_simhash": simhash.op6,
    "op7_packing": packing.op7,
    "op8_url_filters": url_filters.op8,
    "op9_warc": warc.op9,
    "op10_bpe": bpe.op10,
    "op11_spelling": spelling.op11,
    "op12_centroids": centroids.op12,
    "op13_jaccard_join": setjoin.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk_search": topk.OP5_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "op13_jaccard_join": setjoin.OP13_SQL,
}
