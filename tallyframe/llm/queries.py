"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import decontam, html_extract, line_dedup, media, merkle, mixing, simhash, substring_dedup, token_counts, token_output, toxicity, whitening, word_bpe

QUERIES = {
    "op1_bit_planes": token_output.op1_bit_planes,
    "op2_mixing": mixing.op2_mixing,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_media": media.op10_media,
    "op11_whitening": whitening.op11_whitening,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_word_bpe": word_bpe.op13_word_bpe,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_mixing": mixing.ORACLE, "op5_substring_dedup": substring_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
