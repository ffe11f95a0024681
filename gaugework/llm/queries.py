"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprints, langid, mixing, packing, quality, simhash, suffix_dedup, tokenfile, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_mix": mixing.op3_mix,
    "op4_pack": packing.op4_pack,
    "op5_chat": chat.op5_chat,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_tokens": tokenfile.op7_tokens,
    "op8_simhash": simhash.op8_simhash,
    "op9_langid": langid.op9_langid,
    "op10_warc": warc.op10_warc,
}
ORACLE_SQL = {"op3_mix": mixing.OP3_SQL, "op5_chat": chat.OP5_SQL, "op10_warc": warc.OP10_SQL}
