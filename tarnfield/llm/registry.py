"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm import bestpos, bpe, brown, gnat, hnsw, html, jaccard, langid, mixing, pii, quality, secretscan, tokenfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw_dedup": hnsw.op1_hnsw_dedup,
    "op2_secret_scan": secretscan.op2_secret_scan,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_trie_bpe": bpe.op4_trie_bpe,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_line_quality": quality.op6_line_quality,
    "op7_html_text": html.op7_html_text,
    "op8_token_file": tokenfile.op8_token_file,
    "op9_language_id": langid.op9_language_id,
    "op10_pii_terms": pii.op10_pii_terms,
    "op11_brown_classes": brown.op11_brown_classes,
    "op12_hyperplane_negatives": gnat.op12_hyperplane_negatives,
    "op13_best_position": bestpos.op13_best_position,
}

ORACLES: dict[str, str] = {
    "op1_hnsw_dedup": hnsw.SQL,
    "op3_jaccard_join": jaccard.SQL,
    "op5_source_mix": mixing.SQL,
    "op6_line_quality": quality.SQL,
    "op12_hyperplane_negatives": gnat.SQL,
    "op13_best_position": bestpos.SQL,
}
