"""The queries of this subpackage and their SQL, for the entry point."""

from __future__ import annotations

from . import chat, decontaminate, html, jpeg, language, packing, quality, secrets, sharding, simhash

QUERIES = {
    "op1_max_subsequence": html.op1_max_subsequence,
    "op2_cross_parsing": language.op2_cross_parsing,
    "op3_bradley_terry": quality.op3_bradley_terry,
    "op4_interleave": sharding.op4_interleave,
    "op5_best_fit": packing.op5_best_fit,
    "op6_winnowing": decontaminate.op6_winnowing,
    "op7_black_box": chat.op7_black_box,
    "op8_simhash": simhash.op8_simhash,
    "op9_secrets": secrets.op9_secrets,
    "op10_progressive_jpeg": jpeg.op10_progressive_jpeg,
}

SQL = {
    "op4_interleave": sharding.OP4_SQL,
    "op6_winnowing": decontaminate.OP6_SQL,
    "op7_black_box": chat.OP7_SQL,
}
