"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, collocations, decontam, html, jaccard, merkle, mixing, packing, quality, tokens, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_packing": packing.op2_packing,
        "op3_html_extraction": html.op3_html_extraction,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_warc": warc.op5_warc,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_token_output": tokens.op7_token_output,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_url_filters": urls.op10_url_filters,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_mixing": mixing.op13_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op5_warc": warc.OP5_SQL,
        "op8_decontamination": decontam.OP8_SQL,
        "op10_url_filters": urls.OP10_SQL,
        "op11_phrase_collocations": collocations.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
        "op13_mixing": mixing.OP13_SQL,
    }
