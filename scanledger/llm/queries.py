"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, graph, lines, minhash, mixing, multi_index, packing, pii, quality, runs, secrets, trie

QUERIES = {
    "op1_graph_neighbours": graph.query,
    "op2_line_dedup": lines.query,
    "op3_secret_scan": secrets.query,
    "op4_minhash_near_dedup": minhash.query,
    "op5_source_mixing": mixing.query,
    "op6_quality_scores": quality.query,
    "op7_pii_surrogates": pii.query,
    "op8_packing": packing.query,
    "op9_tool_call_linking": chat.query,
    "op10_embedding_near_dedup": multi_index.query,
    "op11_conversation_trie": trie.query,
    "op12_chunked_bpe": bpe.query,
    "op13_periodic_runs": runs.query,
}

ORACLE = {
    "op2_line_dedup": lines.oracle(),
    "op4_minhash_near_dedup": minhash.oracle(),
    "op5_source_mixing": mixing.oracle(),
    "op9_tool_call_linking": chat.oracle(),
    "op11_conversation_trie": trie.oracle(),
    "op13_periodic_runs": runs.oracle(),
}
