"""The queries of the training-data operators and their SQL, where SQL can express one."""

from __future__ import annotations

from provena.llm import licenses, oracles
from provena.llm.bpe import op3_bpe
from provena.llm.lm import op1_lm
from provena.llm.minhash import op10_minhash
from provena.llm.packing import op8_packing
from provena.llm.quality import op7_quality
from provena.llm.secrets import op6_secrets
from provena.llm.substring import op9_substring
from provena.llm.vectors import op5_vectors
from provena.llm.wrappers import op4_html

QUERIES = {
    "op1_lm": op1_lm,
    "op2_licenses": licenses.op2_licenses,
    "op3_bpe": op3_bpe,
    "op4_html": op4_html,
    "op5_vectors": op5_vectors,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_substring": op9_substring,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.oracle(),
    "op5_vectors": oracles.vectors(),
    "op9_substring": oracles.substring(),
    "op10_minhash": oracles.minhash(),
}
