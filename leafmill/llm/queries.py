"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from .decontaminate import op7_decontaminate
from .hmm import op9_lm_score
from .importance_resample import OP11_SQL, op11_importance_resample
from .jaccard_join import op1_jaccard_join
from .line_dedup import OP4_SQL, op4_line_dedup
from .packing import op5_packing
from .quality_fm import op2_quality_classifier
from .quality_rules import op8_quality_rules
from .secrets import op6_secrets
from .simhash_join import op12_simhash_dedup
from .source_divergence import OP13_SQL, op13_source_divergence
from .sql import OP1_SQL, OP3_SQL, OP7_SQL, OP10_SQL
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op10_suffix_dedup

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_score": op9_lm_score,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_importance_resample": op11_importance_resample,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_decontaminate": OP7_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op11_importance_resample": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
