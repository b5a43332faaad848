"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_chat_format
from .langid import op9_language_id
from .linededup import OP10_SQL, op10_line_dedup
from .media import op5_media_columns
from .mixing import op8_mixing
from .packing import op4_best_fit_packing
from .simhash import op6_simhash_near_dedup
from .substrings import op3_suffix_dedup
from .tokencounts import op7_token_counts
from .topk import OP1_SQL, op1_exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_media_columns": op5_media_columns,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op10_line_dedup": OP10_SQL,
}
