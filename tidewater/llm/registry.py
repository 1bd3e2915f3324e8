"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP10_SQL, op10_chat_format
from .jaccard import op3_jaccard_join
from .language import op12_language_id
from .manifest import OP11_SQL, op11_dataset_manifest
from .merkle import op4_merkle_fingerprints
from .oracle import OP2_SQL, OP3_SQL
from .packing import op9_vector_packing
from .pii import op8_pii
from .quality import op6_quality_classifier
from .sentencepiece import op5_sentencepiece
from .substrings import op2_substring_dedup
from .token_counts import op7_token_counts
from .topk import OP1_SQL, op1_exact_topk
from .variants import OP13_SQL, op13_spelling_variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_merkle_fingerprints": op4_merkle_fingerprints,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_token_counts": op7_token_counts,
        "op8_pii": op8_pii,
        "op9_vector_packing": op9_vector_packing,
        "op10_chat_format": op10_chat_format,
        "op11_dataset_manifest": op11_dataset_manifest,
        "op12_language_id": op12_language_id,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": OP1_SQL,
        "op2_substring_dedup": OP2_SQL,
        "op3_jaccard_join": OP3_SQL,
        "op10_chat_format": OP10_SQL,
        "op11_dataset_manifest": OP11_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
