"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import audit, ranking
from tidemark.llm.audit import op11_filter_audit
from tidemark.llm.bpe import op2_bpe
from tidemark.llm.jaccard import op5_jaccard_join
from tidemark.llm.katz import op6_katz
from tidemark.llm.language import op7_language_id
from tidemark.llm.neighbours import op9_nn_descent
from tidemark.llm.packing import op12_harmonic_packing
from tidemark.llm.postings import op10_decontaminate
from tidemark.llm.ranking import op13_ranked_search
from tidemark.llm.secrets import op1_secret_scan
from tidemark.llm.suffixes import op3_suffix_dedup
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.urls import op4_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe": op2_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_katz": op6_katz,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_nn_descent": op9_nn_descent,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_harmonic_packing": op12_harmonic_packing,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE: dict[str, str] = {"op11_filter_audit": audit.ORACLE, "op13_ranked_search": ranking.ORACLE}
