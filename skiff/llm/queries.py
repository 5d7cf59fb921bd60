"""Registered queries of the training-data operators and their SQL (None: tested by brute force)."""

from __future__ import annotations

from skiff.llm.decontamination import OP3_SQL, op3_decontamination
from skiff.llm.html_text import op1_html_extraction
from skiff.llm.jaccard_join import op10_jaccard_join
from skiff.llm.language_id import op4_language_id
from skiff.llm.lm_scoring import op7_lm_scoring
from skiff.llm.packing import op2_packing
from skiff.llm.quality_classifier import op8_quality_classifier
from skiff.llm.quality_rules import OP9_SQL, op9_quality_rules
from skiff.llm.secret_scan import op5_secret_scan
from skiff.llm.span_dedup import op6_span_dedup
from skiff.llm.piece_encoding import op11_piece_encoding
from skiff.llm.centroids import OP12_SQL, op12_centroid_clustering
from skiff.llm.periodic_runs import op13_periodic_runs

QUERIES = {
    "op10_jaccard_join": (op10_jaccard_join, None),
    "op1_html_extraction": (op1_html_extraction, None),
    "op2_packing": (op2_packing, None),
    "op3_decontamination": (op3_decontamination, OP3_SQL),
    "op4_language_id": (op4_language_id, None),
    "op5_secret_scan": (op5_secret_scan, None),
    "op6_span_dedup": (op6_span_dedup, None),
    "op7_lm_scoring": (op7_lm_scoring, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_quality_rules": (op9_quality_rules, OP9_SQL),
    "op11_piece_encoding": (op11_piece_encoding, None),
    "op12_centroid_clustering": (op12_centroid_clustering, OP12_SQL),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
