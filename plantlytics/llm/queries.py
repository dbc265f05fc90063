"""The numbered operators as queries on the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from plantlytics.llm.decontaminate import OP3_SQL, op3_fm_decontamination
from plantlytics.llm.divergence import OP12_SQL, op12_source_divergence
from plantlytics.llm.hard_negatives import OP13_SQL, op13_coordinate_hard_negatives
from plantlytics.llm.lm_score import op10_deleted_interpolation_lm
from plantlytics.llm.mixing import OP1_SQL, op1_mixture_raking
from plantlytics.llm.near_dup import op6_minhash_near_dedup
from plantlytics.llm.packing import op11_cost_balanced_packing
from plantlytics.llm.quality_classifier import op9_bayes_quality_classifier
from plantlytics.llm.quality_rules import op8_mcd_quality_rules
from plantlytics.llm.secrets import OP7_SQL, op7_entropy_secrets
from plantlytics.llm.suffix_dedup import op2_suffix_array_dedup
from plantlytics.llm.toxicity import op4_noisy_channel_toxicity
from plantlytics.llm.url_rules import OP5_SQL, op5_interval_url_rules

QUERIES = {
    "op1_mixture_raking": op1_mixture_raking,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_fm_decontamination": op3_fm_decontamination,
    "op4_noisy_channel_toxicity": op4_noisy_channel_toxicity,
    "op5_interval_url_rules": op5_interval_url_rules,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_entropy_secrets": op7_entropy_secrets,
    "op8_mcd_quality_rules": op8_mcd_quality_rules,
    "op9_bayes_quality_classifier": op9_bayes_quality_classifier,
    "op10_deleted_interpolation_lm": op10_deleted_interpolation_lm,
    "op11_cost_balanced_packing": op11_cost_balanced_packing,
    "op12_source_divergence": op12_source_divergence,
    "op13_coordinate_hard_negatives": op13_coordinate_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_mixture_raking": OP1_SQL,
    "op3_fm_decontamination": OP3_SQL,
    "op5_interval_url_rules": OP5_SQL,
    "op7_entropy_secrets": OP7_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_coordinate_hard_negatives": OP13_SQL,
}
