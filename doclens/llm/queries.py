"""The registered queries of this package and the SQL that checks them."""

from doclens.llm import exact, licenses, lines, merkle, minhash, mixing, packing, phrases, pii, quality, substring, tokens, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_prob_minhash": minhash.op3_prob_minhash,
    "op4_debruijn_repeats": substring.op4_debruijn_repeats,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_skip_chain_pii": pii.op6_skip_chain_pii,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_poisson_mix": mixing.op8_poisson_mix,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_collocations": phrases.op11_collocations,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op4_debruijn_repeats": substring.OP4_SQL,
    "op8_poisson_mix": mixing.OP8_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
    "op11_collocations": phrases.OP11_SQL,
    "op12_line_dedup": lines.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
