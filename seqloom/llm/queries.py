"""One query for each operator over its whole table, with production parameters, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_text, jaccard, language, oracles, packing, pii, repeats, shards, simhash
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pii": lambda s, d: pii.digest(table(s, d, "documents")),
        "op2_simhash": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op3_histogram_shards": lambda s, d: shards.assign(table(s, d, "documents")),
        "op4_chat_format": lambda s, d: chat.digest(table(s, d, "conversations")),
        "op5_decontaminate": lambda s, d: decontaminate.digest(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_html_text": lambda s, d: html_text.extract(table(s, d, "pages")),
        "op7_repeated_spans": lambda s, d: repeats.digest(table(s, d, "documents")),
        "op8_mixture_pack": lambda s, d: packing.pack(table(s, d, "documents")),
        "op9_language_id": lambda s, d: language.digest(table(s, d, "documents")),
        "op10_jaccard_join": lambda s, d: jaccard.components(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries whose rows SQL can state; the others are tested against brute force."""
    return {
        "op4_chat_format": oracles.CHAT,
        "op5_decontaminate": oracles.CONTAMINATION,
        "op7_repeated_spans": oracles.REPEATS,
        "op10_jaccard_join": oracles.NEAR_COPIES,
    }
