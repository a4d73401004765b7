"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontam, jaccard_join, license_scan, mixing, quality, secret_scan, suffix_dedup, topk, warc

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {
    "op1_topk": topk.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_license_scan": license_scan.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_decontamination": decontam.OP5_SQL,
    "op6_jaccard_join": jaccard_join.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_secret_scan": secret_scan.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
}
