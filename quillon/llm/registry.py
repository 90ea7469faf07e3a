"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from quillon.llm import chats, licenses
from quillon.llm.chunks import op10_chunk_dedup
from quillon.llm.decontaminate import op3_decontaminate
from quillon.llm.pages import op1_extract
from quillon.llm.perplexity import op8_quality
from quillon.llm.pieces import op2_sentencepiece
from quillon.llm.repeats import op5_repeats
from quillon.llm.simhash import op4_simhash
from quillon.llm.vectors import op9_embeddings

QUERIES = {
    "op1_extract": op1_extract,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_repeats": op5_repeats,
    "op6_licenses": licenses.op6_licenses,
    "op7_chats": chats.op7_chats,
    "op8_quality": op8_quality,
    "op9_embeddings": op9_embeddings,
    "op10_chunk_dedup": op10_chunk_dedup,
}

ORACLES: dict[str, str] = {
    "op6_licenses": licenses.ORACLE,
    "op7_chats": chats.ORACLE,
}
