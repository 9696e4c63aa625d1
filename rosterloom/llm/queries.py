"""Registered queries of this folder, with DuckDB twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from rosterloom.llm import bpe, conversation_repair, itq, licenses, minhash, mixing, prefix_trie, quality, simhash, token_counts, token_files, toxicity, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_embedding_dedup": itq.op6_embedding_dedup,
    "op7_licenses": licenses.op7_licenses,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_minhash": minhash.op10_minhash,
    "op11_warc": warc.op11_warc,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_minhash": minhash.OP10_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
