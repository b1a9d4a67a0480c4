"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, jaccard, katz, language, lines, quality, secrets, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": lines.op1_lines,
    "op10_chat": chat.op10_chat,
    "op2_language": language.op2_language,
    "op3_secrets": secrets.op3_secrets,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_katz": katz.op5_katz,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_quality": quality.op7_quality,
    "op8_substrings": substrings.op8_substrings,
    "op9_byte_bpe": bpe.op9_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op1_lines": lines.OP1_SQL,
    "op10_chat": chat.OP10_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_jaccard": jaccard.OP6_SQL,
    "op8_substrings": substrings.OP8_SQL,
}
