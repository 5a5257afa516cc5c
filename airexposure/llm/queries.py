"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, license_scan, suffix_dedup, warc
from .conversation_repair import op13_conversation_repair
from .decontaminate import op3_benchmark_decontamination
from .license_scan import op5_license_scan
from .lm_scoring import op6_lm_scoring
from .packing import op9_best_fit_packing
from .quality_classifier import op7_quality_classifier
from .quality_rules import op8_quality_rules
from .sentencepiece_codec import op11_sentencepiece
from .sharding import op1_hypergeometric_sharding
from .simhash_dedup import op10_simhash_near_dedup
from .spelling_variants import op12_spelling_variants
from .suffix_dedup import op2_suffix_dedup
from .warc import op4_warc_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_hypergeometric_sharding, op2_suffix_dedup, op3_benchmark_decontamination, op4_warc_index, op5_license_scan,
        op6_lm_scoring, op7_quality_classifier, op8_quality_rules, op9_best_fit_packing, op10_simhash_near_dedup,
        op11_sentencepiece, op12_spelling_variants, op13_conversation_repair,
    )
}

ORACLES = {
    "op2_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op3_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op4_warc_index": warc.ORACLE_SQL,
    "op5_license_scan": license_scan.ORACLE_SQL,
}
