"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillon.llm.chat import OP4_SQL, op4_chat_format
from quillon.llm.decontaminate import OP8_SQL, op8_decontaminate
from quillon.llm.dedup import OP5_SQL, op5_minhash_dedup
from quillon.llm.html_text import op2_html_text
from quillon.llm.lang_id import op1_language_id
from quillon.llm.mixing import OP7_SQL, op7_mix_sources
from quillon.llm.quality import op9_quality
from quillon.llm.tiff import op10_media_tiff
from quillon.llm.toxicity import op3_toxicity
from quillon.llm.urls import op6_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_mix_sources": op7_mix_sources,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_media_tiff": op10_media_tiff,
}

ORACLE_SQL = {
    "op4_chat_format": OP4_SQL,
    "op5_minhash_dedup": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
}
