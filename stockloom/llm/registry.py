"""The queries of this subpackage, and their SQL where SQL can express them."""

from stockloom.llm import bpe, html_text, jaccard_join, neighbours, oracles, packing, pii, quality, secret_scan, suffix_dedup, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        neighbours.op1_nearest_neighbours, packing.op2_best_fit_packing, quality.op3_quality_rules, toxicity.op4_toxicity, suffix_dedup.op5_suffix_dedup,
        secret_scan.op6_secret_scans, jaccard_join.op7_jaccard_join, pii.op8_pii, bpe.op9_bpe, html_text.op10_html_extraction,
    )
}
ORACLES: dict[str, str] = {"op5_suffix_dedup": oracles.SUFFIX_DEDUP, "op7_jaccard_join": oracles.JACCARD_JOIN}
