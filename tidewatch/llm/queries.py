"""All queries of this subpackage: name -> function (spark, folder) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from . import oracles
from .conversation_repair import op11_conversation_repair
from .decontamination import op1_benchmark_suffix_search
from .entropy_mixing import op4_entropy_mix
from .forced_boundaries import op12_forced_boundary_coding
from .kd_sharding import op9_kd_tree_shards
from .line_templates import op10_line_templates
from .parity_join import op8_parity_sketch_join
from .quality import op5_quality_rules
from .spelling_variants import op13_spelling_variants
from .substring_dedup import op3_repeated_substrings
from .token_counts import op2_section_tokens
from .token_files import op6_token_files
from .url_filter import op7_url_filter

QUERIES = {f.__name__: f for f in (
    op1_benchmark_suffix_search, op2_section_tokens, op3_repeated_substrings, op4_entropy_mix, op5_quality_rules, op6_token_files, op7_url_filter,
    op8_parity_sketch_join, op9_kd_tree_shards, op10_line_templates, op11_conversation_repair, op12_forced_boundary_coding,
    op13_spelling_variants,
)}
ORACLES: dict[str, str] = {
    "op1_benchmark_suffix_search": oracles.BENCHMARK_SUFFIX_SEARCH, "op8_parity_sketch_join": oracles.PARITY_SKETCH_JOIN,
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR, "op13_spelling_variants": oracles.SPELLING_VARIANTS,
}
