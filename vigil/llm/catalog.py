"""Queries of the training-data operators and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from vigil.llm.chat import OP7_SQL, op7_relational_chat
from vigil.llm.decontaminate import op8_latent_decontamination
from vigil.llm.exactdup import OP6_SQL, op6_block_naming
from vigil.llm.langmodel import op5_deleted_interpolation
from vigil.llm.linededup import op1_fuzzy_lines
from vigil.llm.packing import op10_vector_packing
from vigil.llm.pii import op4_bootstrapped_pii
from vigil.llm.prefixtrie import OP11_SQL, op11_prefix_trie
from vigil.llm.sharding import op2_jump_shards
from vigil.llm.simhash import op9_vantage_simhash
from vigil.llm.tokencount import op12_whole_token_counts
from vigil.llm.toxicity import op3_lexicon_toxicity
from vigil.llm.whitening import op13_multiplicity_whitening

QUERIES = {
    "op1_fuzzy_lines": op1_fuzzy_lines,
    "op2_jump_shards": op2_jump_shards,
    "op3_lexicon_toxicity": op3_lexicon_toxicity,
    "op4_bootstrapped_pii": op4_bootstrapped_pii,
    "op5_deleted_interpolation": op5_deleted_interpolation,
    "op6_block_naming": op6_block_naming,
    "op7_relational_chat": op7_relational_chat,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op9_vantage_simhash": op9_vantage_simhash,
    "op10_vector_packing": op10_vector_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whole_token_counts": op12_whole_token_counts,
    "op13_multiplicity_whitening": op13_multiplicity_whitening,
}

ORACLE_SQL = {
    "op6_block_naming": OP6_SQL,
    "op7_relational_chat": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
}
