"""Registered queries of the subpackage and the SQL that they are checked against."""

from __future__ import annotations

from quillon.llm import op1_chat, op2_quality, op3_ordinal, op4_packing, op5_suffix_dedup, op6_token_files, op7_warc, op8_html, op9_decontaminate, op10_ngram_join, op11_repair, op12_sharding, op13_alignment

QUERIES = {
    "op1_chat": op1_chat.op1_chat,
    "op2_quality": op2_quality.op2_quality,
    "op3_ordinal": op3_ordinal.op3_ordinal,
    "op4_packing": op4_packing.op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup.op5_suffix_dedup,
    "op6_token_files": op6_token_files.op6_token_files,
    "op7_warc": op7_warc.op7_warc,
    "op8_html": op8_html.op8_html,
    "op9_decontaminate": op9_decontaminate.op9_decontaminate,
    "op10_ngram_join": op10_ngram_join.op10_ngram_join,
    "op11_repair": op11_repair.op11_repair,
    "op12_sharding": op12_sharding.op12_sharding,
    "op13_alignment": op13_alignment.op13_alignment,
}
ORACLE_SQL = {"op1_chat": op1_chat.ORACLE_SQL, "op2_quality": op2_quality.ORACLE_SQL, "op9_decontaminate": op9_decontaminate.ORACLE_SQL, "op12_sharding": op12_sharding.ORACLE_SQL}
