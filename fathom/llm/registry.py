"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprint, html, language, media, minhash, mixing, packing, rollup, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pack_documents": packing.op1_pack_documents,
        "op2_extract_text": html.op2_extract_text,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op5_token_rollup": rollup.op5_token_rollup,
        "op6_format_chats": chat.op6_format_chats,
        "op4_fingerprint_documents": fingerprint.op4_fingerprint_documents,
        "op7_store_media": media.op7_store_media,
        "op8_judge_urls": urls.op8_judge_urls,
        "op9_near_duplicates": minhash.op9_near_duplicates,
        "op10_identify_languages": language.op10_identify_languages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mixing.OP3_SQL,
        "op6_format_chats": chat.OP6_SQL,
        "op8_judge_urls": urls.OP8_SQL,
    }
