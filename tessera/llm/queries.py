"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.chat import OP1_SQL, op1_chat_formatting
from tessera.llm.decontaminate import op2_benchmark_decontamination
from tessera.llm.mixing import op7_mix_sources
from tessera.llm.pii import op3_personal_data
from tessera.llm.quality_classifier import op8_quality_classifier
from tessera.llm.quality_rules import op10_quality_rules
from tessera.llm.secrets import op5_secret_scan
from tessera.llm.sharding import op4_two_pass_shuffle
from tessera.llm.simhash import op9_simhash_near_dedup
from tessera.llm.toxicity import op6_toxicity_nearest

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_personal_data": op3_personal_data,
    "op4_two_pass_shuffle": op4_two_pass_shuffle,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity_nearest": op6_toxicity_nearest,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op1_chat_formatting": OP1_SQL,
}
