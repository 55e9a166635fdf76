"""The numbered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, line_dedup, prefix_trie
from corpusloom.llm.byte_bpe import op12_byte_bpe
from corpusloom.llm.decontamination import op8_decontamination
from corpusloom.llm.jaccard_join import op10_jaccard_join
from corpusloom.llm.language import op2_language_id
from corpusloom.llm.language_model import op5_lm_scoring
from corpusloom.llm.line_dedup import op3_line_dedup
from corpusloom.llm.media import op7_media_columns
from corpusloom.llm.packing import op1_best_fit_packing
from corpusloom.llm.pii import op4_pii
from corpusloom.llm.prefix_trie import op13_prefix_trie
from corpusloom.llm.token_counts import op6_token_counts
from corpusloom.llm.toxicity import op9_toxicity
from corpusloom.llm.whitening import op11_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_language_id, op3_line_dedup, op4_pii, op5_lm_scoring,
        op6_token_counts, op7_media_columns, op8_decontamination, op9_toxicity, op10_jaccard_join,
        op11_embedding_whitening, op12_byte_bpe, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op8_decontamination": decontamination.SQL, "op13_prefix_trie": prefix_trie.SQL}
