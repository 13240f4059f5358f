"""The corpus operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP8_SQL, op8_chat_format
from .decontaminate import OP9_SQL, benchmark_proximity, op9_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .importance import OP12_SQL, op12_importance_resampling
from .language_id import op3_language_id
from .minhash_dedup import op1_minhash_dedup
from .packing import op4_best_fit_packing
from .quality import op13_quality_classifier
from .substring_dedup import op10_substring_dedup
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op5_token_counts
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_quality_classifier": op13_quality_classifier,
    "benchmark_proximity": benchmark_proximity,
}

SQL = {"op6_exact_dedup": OP6_SQL, "op8_chat_format": OP8_SQL, "op9_decontaminate": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_importance_resampling": OP12_SQL}
