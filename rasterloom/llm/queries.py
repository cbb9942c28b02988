"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import (chat, collocations, decontam, embeddings, langid, licenses, lines, minhash, mixing, oracles, pieces, spelling, substring,
               tokens)

QUERIES: dict = {
    "op1_token_simple8b": tokens.op1_token_simple8b,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_embedding_dedup": embeddings.op8_embedding_dedup,
    "op9_chat_quotes": chat.op9_chat_quotes,
    "op10_dart_minhash": minhash.op10_dart_minhash,
    "op11_collocations": collocations.op11_collocations,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
#: The tokenizers (op1, op12), the draws of the mix (op3) and the fitted model (op6) are beyond SQL; tests/llm has plain versions.
ORACLES: dict = {
    "op2_substring_dedup": oracles.SUBSTRINGS,
    "op4_license_scan": oracles.LICENSES,
    "op5_line_dedup": lines.ORACLE_SQL,
    "op7_decontaminate": oracles.CONTAMINATION,
    "op8_embedding_dedup": oracles.EMBEDDINGS,
    "op9_chat_quotes": chat.ORACLE_SQL,
    "op10_dart_minhash": oracles.NEAR_DUPLICATES,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
