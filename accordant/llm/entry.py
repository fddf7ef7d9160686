"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

import corpus_pipeline

from . import bpe_codec, centroids, jaccard_forest, language_id, media_sequences, packing, preferences, quality_rules, release, secrets, sentence_spans, token_counts, token_files


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_best_fit_packing": packing.query,
        "op3_media_sequences": media_sequences.query,
        "op4_token_files": token_files.query,
        "op5_token_counts": token_counts.query,
        "op6_jaccard_forest": jaccard_forest.query,
        "op7_bpe_codec": bpe_codec.query,
        "op8_preferences": preferences.query,
        "op9_sentence_spans": sentence_spans.query,
        "op10_quality_rules": quality_rules.query,
        "op11_centroids": centroids.query,
        "op12_secret_scan": secrets.query,
        "op13_release": release.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_preferences": preferences.oracle_sql(),
        "op9_sentence_spans": sentence_spans.oracle_sql(),
        "op10_quality_rules": quality_rules.oracle_sql(),
        "op11_centroids": centroids.oracle_sql(),
        "op12_secret_scan": secrets.oracle_sql(),
        "op13_release": release.oracle_sql(),
    }
