"""Queries of the operators and the SQL that DuckDB checks them with."""

from __future__ import annotations

from awardtrace.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from awardtrace.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from awardtrace.llm.licenses import op3_license_scans
from awardtrace.llm.mixing import OP5_SQL, op5_mixing
from awardtrace.llm.ngram_join import OP1_SQL, op1_ngram_jaccard_join
from awardtrace.llm.packing import op12_packing
from awardtrace.llm.quality import OP4_SQL, op4_quality_rules
from awardtrace.llm.sampled_pieces import op6_sentencepiece
from awardtrace.llm.secret_scans import OP8_SQL, op8_secret_scans
from awardtrace.llm.sharding import OP9_SQL, op9_sharding
from awardtrace.llm.toxicity import op2_toxicity
from awardtrace.llm.turn_repair import OP11_SQL, op11_turn_repair
from awardtrace.llm.url_filters import OP10_SQL, op10_url_filters

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_license_scans": op3_license_scans,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_sharding": op9_sharding,
    "op10_url_filters": op10_url_filters,
    "op11_turn_repair": op11_turn_repair,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_secret_scans": OP8_SQL,
    "op9_sharding": OP9_SQL,
    "op10_url_filters": OP10_SQL,
    "op11_turn_repair": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
