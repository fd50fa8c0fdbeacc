"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP1_SQL, op1_chat_format
from .fingerprints import op4_fingerprints
from .html_extract import op2_html_extract
from .lexical_search import OP12_SQL, op12_lexical_search
from .lm_scoring import op6_lm_scoring
from .mixing import op9_mixing
from .near_dedup import OP8_SQL, op8_near_dedup
from .personal_data import op11_personal_data
from .quality_classifier import op3_quality_classifier
from .quality_rules import op10_quality_rules
from .sentence_pieces import op7_sentencepiece
from .sharding import op5_sharding
from .token_alignment import op13_token_alignment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_html_extract": op2_html_extract,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_fingerprints": op4_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_near_dedup": op8_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_personal_data": op11_personal_data,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op8_near_dedup": OP8_SQL,
    "op12_lexical_search": OP12_SQL,
}
