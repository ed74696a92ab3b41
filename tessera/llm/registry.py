"""The queries of this subpackage and the SQL of those that SQL can express."""

from tessera.llm import exact_dedup, hmm, langid, minhash, mixing, order_minhash, packing, pii, prefix_trie, resampling, sharding, topk, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_topk": topk.op3_topk,
    "op4_pii": pii.op4_pii,
    "op5_minhash": minhash.op5_minhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_hmm": hmm.op7_hmm,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_packing": packing.op9_packing,
    "op10_langid": langid.op10_langid,
    "op11_order_minhash": order_minhash.op11_order_minhash,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_resampling": resampling.op13_resampling,
}
SQL = {"op2_url_filter": url_filter.OP2_SQL, "op3_topk": topk.OP3_SQL, "op5_minhash": minhash.OP5_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_resampling": resampling.OP13_SQL}
