"""Queries of this subpackage for the driver, by name, and the SQL that some are held against."""

from __future__ import annotations

from clausework.llm import chat_format, exact_topk, suffix_dedup
from clausework.llm.chat_format import op8_chat_format
from clausework.llm.decontamination import op6_decontamination
from clausework.llm.exact_topk import op5_exact_topk
from clausework.llm.language_id import op9_language_id
from clausework.llm.near_dedup import op7_near_dedup
from clausework.llm.sentence_pieces import op3_sentencepiece
from clausework.llm.sharding import op1_hypergeometric_sharding
from clausework.llm.suffix_dedup import op10_suffix_dedup
from clausework.llm.token_counts import op2_token_counts
from clausework.llm.toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_hypergeometric_sharding,
        op2_token_counts,
        op3_sentencepiece,
        op4_toxicity,
        op5_exact_topk,
        op6_decontamination,
        op7_near_dedup,
        op8_chat_format,
        op9_language_id,
        op10_suffix_dedup,
    )
}
ORACLE_SQL = {"op5_exact_topk": exact_topk.SQL, "op8_chat_format": chat_format.SQL, "op10_suffix_dedup": suffix_dedup.SQL}
