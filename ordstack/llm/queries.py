"""The registered queries of this package and the SQL texts of those that SQL can express."""

from __future__ import annotations

from ordstack.llm.bpe import op9_bpe_round_trip
from ordstack.llm.collocations import OP12_SQL, op12_collocations
from ordstack.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from ordstack.llm.language_id import op1_language_id
from ordstack.llm.license_scan import OP6_SQL, op6_license_scan
from ordstack.llm.mixing import OP2_SQL, op2_mix_sources
from ordstack.llm.order_minhash import op5_order_minhash
from ordstack.llm.quality_rules import OP8_SQL, op8_risk_controlled_rules
from ordstack.llm.quality_vote import op11_quality_vote
from ordstack.llm.records import op3_binary_records
from ordstack.llm.sharding import op7_jump_hash_shards
from ordstack.llm.simhash import op10_simhash_near_dedup
from ordstack.llm.suffix_dedup import op4_suffix_array_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_binary_records": op3_binary_records,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_order_minhash": op5_order_minhash,
    "op6_license_scan": op6_license_scan,
    "op7_jump_hash_shards": op7_jump_hash_shards,
    "op8_risk_controlled_rules": op8_risk_controlled_rules,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_quality_vote": op11_quality_vote,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op2_mix_sources": OP2_SQL,
    "op6_license_scan": OP6_SQL,
    "op8_risk_controlled_rules": OP8_SQL,
    "op12_collocations": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
