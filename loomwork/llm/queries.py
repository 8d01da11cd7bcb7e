"""Name -> query of every training-data operator, and SQL where it can express one."""

from __future__ import annotations

from loomwork.llm import chat, debruijn, decontam, langid, lines, merkle, packing, periodic, quality, rules, sharding, simhash, suffixes

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_decontam": decontam.op2_decontam,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_debruijn": debruijn.op7_debruijn,
    "op8_rules": rules.op8_rules,
    "op9_sharding": sharding.op9_sharding,
    "op10_simhash": simhash.op10_simhash,
    "op11_lines": lines.op11_lines,
    "op12_runs": periodic.op12_runs,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op5_chat": chat.OP5_SQL,
    "op6_suffixes": suffixes.OP6_SQL,
    "op7_debruijn": debruijn.OP7_SQL,
    "op8_rules": rules.OP8_SQL,
    "op11_lines": lines.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
