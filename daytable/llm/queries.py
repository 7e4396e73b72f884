"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from daytable.llm import counts, lines, mix, neardup, packing, quality, runs, shard, sketches, substrings, turns, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_va_file": vectors.op2_va_file,
    "op3_prob_min_hash": neardup.op3_prob_min_hash,
    "op4_feistel_shards": shard.op4_feistel_shards,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_debruijn_dedup": substrings.op6_debruijn_dedup,
    "op7_longest_match_counts": counts.op7_longest_match_counts,
    "op8_slack_packing": packing.op8_slack_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_systematic_mix": mix.op10_systematic_mix,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_astar_repair": turns.op12_astar_repair,
    "op13_lookup_sketches": sketches.op13_lookup_sketches,
    "quality_ablations": quality.quality_ablations,
}
SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_va_file": vectors.OP2_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op6_debruijn_dedup": substrings.OP6_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_systematic_mix": mix.OP10_SQL,
    "op11_periodic_runs": runs.OP11_SQL,
    "op12_astar_repair": turns.OP12_SQL,
    "op13_lookup_sketches": sketches.OP13_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
