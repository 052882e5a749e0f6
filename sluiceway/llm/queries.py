"""The queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from .decontaminate import op8_decontamination
from .htmltext import op2_html
from .jaccard import op1_ngram_jaccard
from .langid import op10_language_id
from .merkle import OP11_SQL, op11_merkle_proofs
from .packing import op9_packing
from .pii import op7_pii
from .pq import op6_embedding_dedup
from .prefixtrie import OP13_SQL, op13_prefix_trie
from .secretscan import op3_secret_scan
from .sharding import OP4_SQL, op4_sharding
from .tokenbin import op12_bit_packing
from .urlfilter import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_html": op2_html,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_url_filters": op5_url_filters,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_merkle_proofs": op11_merkle_proofs,
    "op12_bit_packing": op12_bit_packing,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {"op4_sharding": OP4_SQL, "op5_url_filters": OP5_SQL, "op11_merkle_proofs": OP11_SQL, "op13_prefix_trie": OP13_SQL}
