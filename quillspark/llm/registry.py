"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillspark.llm import chat, decontam, langid, mixing, quality, secrets, sharding, simhash, syncmers, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        sharding.op2_sharding,
        warc.op3_warc,
        decontam.op4_decontamination,
        mixing.op5_mixing,
        syncmers.op6_fingerprints,
        secrets.op7_secrets,
        langid.op8_language_id,
        chat.op9_chat,
        simhash.op10_simhash_near_dedup,
    )
}
ORACLE_SQL = {"op3_warc": warc.OP3_SQL, "op4_decontamination": decontam.OP4_SQL, "op5_mixing": mixing.OP5_SQL, "op7_secrets": secrets.OP7_SQL, "op9_chat": chat.OP9_SQL}
