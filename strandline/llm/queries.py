"""The corpus operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from . import chat, contamination, jaccard, lines, quality, substring, suffix
from .bpe import op5_bpe_encode_decode
from .chat import op8_chat_formatting
from .contamination import op9_benchmark_decontamination
from .jaccard import op10_ngram_jaccard_join
from .lines import op1_line_dedup, op1_line_dedup_pairs
from .quality import op7_quality_rules
from .scoring import op2_lm_scoring
from .substring import op3_substring_dedup
from .suffix import op6_suffix_array_dedup
from .token_files import op4_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_lm_scoring,
        op3_substring_dedup,
        op4_token_files,
        op5_bpe_encode_decode,
        op6_suffix_array_dedup,
        op7_quality_rules,
        op8_chat_formatting,
        op9_benchmark_decontamination,
        op10_ngram_jaccard_join,
        op1_line_dedup_pairs,
    )
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": lines.ORACLE_SQL,
    "op1_line_dedup_pairs": lines.PAIRS_SQL,
    "op3_substring_dedup": substring.ORACLE_SQL,
    "op6_suffix_array_dedup": suffix.ORACLE_SQL,
    "op7_quality_rules": quality.ORACLE_SQL,
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op9_benchmark_decontamination": contamination.ORACLE_SQL,
    "op10_ngram_jaccard_join": jaccard.ORACLE_SQL,
}
