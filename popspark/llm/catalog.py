"""Queries of the corpus operators and, where SQL can express them, the SQL that checks them."""

import corpus_pipeline
from popspark.llm import bpe, conversations, ctw, embedding_dedup, exact_dedup, fingerprints, language_id, mixing, ngram_join, quality, substring_dedup, token_counts, vector_codes

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_ctw": ctw.op4_ctw,
    "op5_language_id": language_id.op5_language_id,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_vector_codes": vector_codes.op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}
#: Queries whose rows SQL cannot express are tested in tests/llm.
ORACLES = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op8_embedding_dedup": embedding_dedup.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
