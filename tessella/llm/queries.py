"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctw import op11_context_tree_weighting
from .decontaminate import OP9_SQL, op9_decontamination
from .fim import OP12_SQL, op12_fill_in_middle
from .jaccard import op1_ngram_jaccard_join
from .language_id import op7_language_id
from .licenses import op8_license_scans
from .packing import op5_packing
from .pii import op4_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .secrets import op2_secret_scans
from .token_files import op3_token_files
from .token_counts import op6_token_counts
from .topk import OP10_SQL, op10_exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scans": op2_secret_scans,
    "op3_token_files": op3_token_files,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_license_scans": op8_license_scans,
    "op9_decontamination": op9_decontamination,
    "op10_exact_topk": op10_exact_topk,
    "op11_context_tree_weighting": op11_context_tree_weighting,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {"op9_decontamination": OP9_SQL, "op10_exact_topk": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
