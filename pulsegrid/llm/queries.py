"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import centroids, decontamination, exact_dedup, fill_in_middle, html_extraction, langid, line_dedup, mixing, quality, simhash, token_counts, token_files, topk

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_html": html_extraction.op3_html,
    "op4_topk": topk.op4_topk,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_simhash": simhash.op9_simhash,
    "op10_langid": langid.op10_langid,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_centroids": centroids.op13_centroids,
}
ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op4_topk": topk.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
