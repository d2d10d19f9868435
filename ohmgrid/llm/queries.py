"""Queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from .bpe import op7_token_counts
from .decontamination import op5_decontamination
from .jaccard_join import OP2_SQL, op2_jaccard_join
from .language_id import op3_language_id
from .packing import op10_best_fit_packing
from .pii import op6_pii
from .quality_classifier import op1_quality_classifier
from .quality_rules import op9_quality_rules
from .sharding import OP8_SQL, op8_sharding
from .url_filters import op4_url_filters

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op8_sharding": OP8_SQL}
