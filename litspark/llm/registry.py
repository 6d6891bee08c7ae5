"""Queries of this package, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from . import op3_line_dedup, op5_exact_dedup, op6_ngram_join, op8_mixing, op12_hard_negatives
from .op1_token_counts import op1_token_counts
from .op2_quality_rules import op2_quality_rules
from .op4_pii import op4_pii
from .op7_tool_calls import op7_tool_calls
from .op9_quality_classifier import op9_quality_classifier
from .op10_packing import op10_packing
from .op11_conversation_repair import op11_conversation_repair
from .op13_best_fit_packing import op13_best_fit_packing

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup.op3_line_dedup,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup.op5_exact_dedup,
    "op6_ngram_join": op6_ngram_join.op6_ngram_join,
    "op7_tool_calls": op7_tool_calls,
    "op8_mixing": op8_mixing.op8_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives.op12_hard_negatives,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLE_SQL = {
    "op3_line_dedup": op3_line_dedup.ORACLE,
    "op5_exact_dedup": op5_exact_dedup.ORACLE,
    "op6_ngram_join": op6_ngram_join.ORACLE,
    "op8_mixing": op8_mixing.ORACLE,
    "op12_hard_negatives": op12_hard_negatives.ORACLE,
}
