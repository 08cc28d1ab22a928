"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from skerry.llm.collocations import OP13_SQL, op13_phrase_collocations
from skerry.llm.chat import OP10_SQL, op10_chat_format
from skerry.llm.html_extract import op1_html_extraction
from skerry.llm.importance import OP11_SQL, op11_importance_resampling
from skerry.llm.media import op5_media_columns
from skerry.llm.mixing import OP2_SQL, op2_source_mixing
from skerry.llm.packing import op3_best_fit_packing
from skerry.llm.quality import op6_quality_classifier
from skerry.llm.repeats import op4_suffix_dedup
from skerry.llm.sharding import op12_sharding
from skerry.llm.simhash import op7_simhash_near_dedup
from skerry.llm.token_store import op9_token_store
from skerry.llm.topk import OP8_SQL, op8_exact_topk


def queries() -> dict:
    return {"op1_html_extraction": op1_html_extraction, "op2_source_mixing": op2_source_mixing, "op3_best_fit_packing": op3_best_fit_packing, "op4_suffix_dedup": op4_suffix_dedup, "op5_media_columns": op5_media_columns, "op6_quality_classifier": op6_quality_classifier, "op7_simhash_near_dedup": op7_simhash_near_dedup, "op8_exact_topk": op8_exact_topk, "op9_token_store": op9_token_store, "op10_chat_format": op10_chat_format, "op11_importance_resampling": op11_importance_resampling, "op12_sharding": op12_sharding, "op13_phrase_collocations": op13_phrase_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "op8_exact_topk": OP8_SQL, "op10_chat_format": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
