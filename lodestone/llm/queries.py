"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, conversation_trie, decontaminate, exact_dedup, html_text, mixing, quality, secrets, simhash, substring_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "secrets_base": secrets.secrets_base,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_simhash": simhash.op3_simhash,
        "op4_html_text": html_text.op4_html_text,
        "op5_mix": mixing.op5_mix,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_quality": quality.op8_quality,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_conversation_trie": conversation_trie.op11_conversation_trie,
        "op12_warc": archives.op12_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "secrets_base": secrets.BASE_SQL,
        "op5_mix": mixing.OP5_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_substring_dedup": substring_dedup.OP7_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_conversation_trie": conversation_trie.OP11_SQL,
        "op12_warc": archives.OP12_SQL,
    }
