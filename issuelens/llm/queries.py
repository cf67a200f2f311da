"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from .op01_packing import op1_packing
from .op02_toxicity import op2_toxicity
from .op03_simhash import op3_fingerprints
from .op04_mixing import op4_mixing
from .op05_tokens import op5_token_shards
from .op06_substrings import op6_repeated_substrings
from .op07_pii import op7_pii
from .op08_minhash import op8_minhash
from .op09_language import op9_language_id
from .op10_quality import op10_quality_rules
from .op11_collocations import op11_collocations
from .op12_tokens import op12_token_counts
from .op13_spelling import op13_spelling_variants
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {f.__name__: f for f in (
    op1_packing, op2_toxicity, op3_fingerprints, op4_mixing, op5_token_shards, op6_repeated_substrings, op7_pii, op8_minhash,
    op9_language_id, op10_quality_rules, op11_collocations, op12_token_counts, op13_spelling_variants)}
