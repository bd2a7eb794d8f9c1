"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_ann
from .bpe import op1_bpe
from .chat import OP7_SQL, op7_chat
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op10_html
from .near_dedup import op9_near_dedup
from .packing import op8_packing
from .rules import op3_quality
from .substring import op2_substring_dedup
from .token_files import op5_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_ann": op4_ann,
    "op5_token_files": op5_token_files,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat": op7_chat,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_html": op10_html,
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": OP6_SQL,
    "op7_chat": OP7_SQL,
}
