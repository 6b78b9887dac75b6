"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.bpe import op2_bpe
from auditlake.llm.decontaminate import OP6_SQL, op6_decontaminate
from auditlake.llm.embeddings import op4_embeddings
from auditlake.llm.filter_audit import OP11_SQL, op11_filter_audit
from auditlake.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from auditlake.llm.jaccard import op1_jaccard
from auditlake.llm.language_model import op8_language_model
from auditlake.llm.licenses import op10_licenses
from auditlake.llm.lines import op5_lines
from auditlake.llm.sharding import op3_shards
from auditlake.llm.token_file import op9_token_file
from auditlake.llm.token_counts import op13_token_counts
from auditlake.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_bpe": op2_bpe,
    "op3_shards": op3_shards,
    "op4_embeddings": op4_embeddings,
    "op5_lines": op5_lines,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_language_model": op8_language_model,
    "op9_token_file": op9_token_file,
    "op10_licenses": op10_licenses,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op6_decontaminate": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL}
