"""The opN_<name> queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, embedding_dups, language, licenses, line_dedup, minhash, mixing, quality, sentencepiece_bpe, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_bpe.op1_sentencepiece,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_quality": quality.op5_quality,
    "op6_embedding_dups": embedding_dups.op6_embedding_dups,
    "op7_mixing": mixing.op7_mixing,
    "op8_minhash": minhash.op8_minhash,
    "op9_language_id": language.op9_language_id,
    "op10_warc": warc.op10_warc,
}

SQL = {
    "op2_license_scan": licenses.OP2_SQL,
    "op5_quality": quality.OP5_SQL,
    "op6_embedding_dups": embedding_dups.OP6_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
}
