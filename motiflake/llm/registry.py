"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from . import chat, html, langid, media, mixing, packing, pii, shards, simhash, topk


def queries() -> dict:
    return {
        "op1_topk": topk.query,
        "op2_pii": pii.query,
        "op3_media": media.query,
        "op4_mixing": mixing.query,
        "op5_language": langid.query,
        "op6_simhash": simhash.query,
        "op7_chat": chat.query,
        "op8_sharding": shards.query,
        "op9_html": html.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.SQL}
