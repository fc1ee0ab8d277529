"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import brown, codebooks, embeddings, exact, fingerprint, langid, packing, pieces, quality, simhash, spelling, token_files, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_pack": packing.op3_pack,
    "op4_token_files": token_files.op4_token_files,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_brown": brown.op7_brown,
    "op8_quality": quality.op8_quality,
    "op9_urls": urls.op9_urls,
    "op10_langid": langid.op10_langid,
    "op11_spelling": spelling.op11_spelling,
    "op12_codes": codebooks.op12_codes,
    "op13_exact": exact.op13_exact,
}

ORACLE_SQL: dict[str, str] = {
    "op9_urls": urls.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_codes": codebooks.OP12_SQL,
    "op13_exact": exact.OP13_SQL,
}
