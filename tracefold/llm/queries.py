"""Queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, gif, html, langid, lines, mixing, setjoin, tokens, warc, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisit": warc.op1_warc_revisit,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_lengths": tokens.op3_token_lengths,
    "op4_gif_media": gif.op4_gif_media,
    "op5_line_templates": lines.op5_line_templates,
    "op6_jaccard_join": setjoin.op6_jaccard_join,
    "op7_html_main_text": html.op7_html_main_text,
    "op8_language_id": langid.op8_language_id,
    "op9_chat_collapse": chat.op9_chat_collapse,
    "op10_decontaminate": winnow.op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op5_line_templates": lines.OP5_SQL,
    "op9_chat_collapse": chat.OP9_SQL,
    "op10_decontaminate": winnow.OP10_SQL,
}
