"""The queries of this subpackage, by name, and the SQL that repeats them where SQL can."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .fingerprints import op2_document_fingerprints
from .language import op3_language_id
from .mixing import op7_source_mixing
from .packing import op5_best_fit_packing
from .quality import op6_quality_classifier
from .secrets import op4_secret_scan
from .simhash_dedup import op1_simhash_near_dedup
from .toxicity import op10_toxicity
from .url_filter import OP8_SQL, op8_url_filter

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_source_mixing": op7_source_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op8_url_filter": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
}
