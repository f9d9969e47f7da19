"""The registered query of each operator of this subpackage."""

from __future__ import annotations

from lodestack.llm.pii import op1_pii_anchor_expansion
from lodestack.llm.bm25 import op8_bm25_block_max
from lodestack.llm.chat import op6_chat_role_repair
from lodestack.llm.decontamination import op9_benchmark_decontamination
from lodestack.llm.langid import language_id_pages, op3_language_id
from lodestack.llm.lm import op2_subword_lattice_lm
from lodestack.llm.packing import op5_best_fit_packing
from lodestack.llm.pieces import op13_sentencepiece_offsets
from lodestack.llm.runs import op12_periodic_runs
from lodestack.llm.secrets import op10_secret_markov
from lodestack.llm.simhash import op7_simhash_near_dedup
from lodestack.llm.tokens import op4_token_id_orc
from lodestack.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_pii_anchor_expansion": op1_pii_anchor_expansion,
    "op2_subword_lattice_lm": op2_subword_lattice_lm,
    "op3_language_id": op3_language_id,
    "language_id_pages": language_id_pages,
    "op4_token_id_orc": op4_token_id_orc,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chat_role_repair": op6_chat_role_repair,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_bm25_block_max": op8_bm25_block_max,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_markov": op10_secret_markov,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_sentencepiece_offsets": op13_sentencepiece_offsets,
}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {}
