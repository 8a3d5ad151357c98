"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import OP3_SQL, op3_decontamination
from .hard_negatives import op11_hard_negatives
from .jaccard_join import op5_ngram_jaccard
from .license_scan import op10_license_scan
from .lm_scoring import op1_cross_entropy
from .packing import op2_retrieval_packing
from .quality_classifier import op6_quality_discriminant
from .quality_rules import OP8_SQL, op8_line_frequency
from .secret_scan import op7_secret_scan
from .substring_dedup import op12_substring_dedup
from .token_counts import op9_token_counts
from .url_filter import op4_url_filter
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_cross_entropy": op1_cross_entropy,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality_discriminant": op6_quality_discriminant,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_frequency": op8_line_frequency,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {"op3_decontamination": OP3_SQL, "op8_line_frequency": OP8_SQL}
