"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from triago.llm import archives, chat, divergence, interactions, language, media, mixing, quality, risk_rules, segment, simhash, token_files, url_rules


def queries() -> dict:
    return {
        "op1_pareto_mix": mixing.op1_pareto_mix,
        "op2_arc_to_warc": archives.op2_arc_to_warc,
        "op10_media_shards": media.op10_media_shards,
        "op3_simhash_components": simhash.op3_simhash_components,
        "op4_bradley_terry": quality.op4_bradley_terry,
        "op6_ftrl_language": language.op6_ftrl_language,
        "op8_gumbel_segments": segment.op8_gumbel_segments,
        "op5_risk_rules": risk_rules.op5_risk_rules,
        "op7_chat_round_trip": chat.op7_chat_round_trip,
        "pipeline": corpus_pipeline.run,
        "op9_url_rules": url_rules.op9_url_rules,
        "op11_token_files": token_files.op11_token_files,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_filter_interactions": interactions.op13_filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": mixing.ORACLE, "op7_chat_round_trip": chat.ORACLE, "op9_url_rules": url_rules.ORACLE, "op12_source_divergence": divergence.ORACLE,
        "op13_filter_interactions": interactions.ORACLE,
    }
