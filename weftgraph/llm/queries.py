"""Queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

from .chat_format import OP9_SQL, op9_chat_formatting
from .decontamination import OP4_SQL, op4_benchmark_decontamination
from .delta_lloyd import OP11_SQL, op11_centroid_clustering
from .hard_negatives import OP12_SQL, op12_hard_negative_mining
from .line_dedup import op3_line_dedup
from .ngram_join import OP8_SQL, op8_ngram_jaccard_join
from .quality_classifier import op1_quality_classifier
from .quality_rules import OP7_SQL, op7_quality_rules
from .source_mixing import OP5_SQL, op5_source_mixing
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .suffix_dedup import OP13_SQL, op13_suffix_array_dedup
from .token_counts import op2_token_counts
from .token_files import op6_token_id_output

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_token_counts,
        op3_line_dedup,
        op4_benchmark_decontamination,
        op5_source_mixing,
        op6_token_id_output,
        op7_quality_rules,
        op8_ngram_jaccard_join,
        op9_chat_formatting,
        op10_substring_dedup,
        op11_centroid_clustering,
        op12_hard_negative_mining,
        op13_suffix_array_dedup,
    )
}

#: Queries without a twin are tested against brute force (tests/llm).
ORACLE_SQL = {
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_source_mixing": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_hard_negative_mining": OP12_SQL,
    "op13_suffix_array_dedup": OP13_SQL,
}
