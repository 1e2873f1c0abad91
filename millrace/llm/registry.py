"""Queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from millrace.llm.decontaminate import OP10_SQL, op10_benchmark_decontamination
from millrace.llm.filter_audit import OP13_SQL, op13_filter_audit
from millrace.llm.html_text import op7_html_extraction
from millrace.llm.licenses import op9_license_scans
from millrace.llm.pitman_yor import op1_lm_scoring
from millrace.llm.quality import op5_quality_rules
from millrace.llm.radix_dedup import OP11_SQL, op11_exact_dedup
from millrace.llm.secrets import op8_secret_scans
from millrace.llm.sentence_pieces import op6_sentence_pieces
from millrace.llm.simhash_dedup import op2_simhash_dedup
from millrace.llm.token_alignment import op12_token_alignment
from millrace.llm.token_count import op4_token_counts
from millrace.llm.url_filters import OP3_SQL, op3_url_filters

_ALL = (
    op1_lm_scoring,
    op2_simhash_dedup,
    op3_url_filters,
    op4_token_counts,
    op5_quality_rules,
    op6_sentence_pieces,
    op7_html_extraction,
    op8_secret_scans,
    op9_license_scans,
    op10_benchmark_decontamination,
    op11_exact_dedup,
    op12_token_alignment,
    op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op3_url_filters": OP3_SQL, "op10_benchmark_decontamination": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op13_filter_audit": OP13_SQL}
