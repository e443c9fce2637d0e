"""The queries of this subpackage, with SQL twins where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, language_id, license_scan, lz_fingerprint, media_chunks, mixing, ngram_join, token_shards, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_mixing": mixing.op3_mixing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_media_chunks": media_chunks.op5_media_chunks,
    "op6_lz_fingerprint": lz_fingerprint.op6_lz_fingerprint,
    "op7_token_shards": token_shards.op7_token_shards,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_language_id": language_id.op9_language_id,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op8_url_rules": url_rules.ORACLE,
}
