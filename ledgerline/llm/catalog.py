"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerline.llm import exact_dedup, lexical_search, license_scan, vp_tree, warc
from ledgerline.llm.bagminhash import op10_bagminhash
from ledgerline.llm.exact_dedup import op4_exact_dedup
from ledgerline.llm.lexical_search import op13_fp_tree_search
from ledgerline.llm.license_scan import op3_license_scan
from ledgerline.llm.mixing import op7_mixing
from ledgerline.llm.packing import op2_best_fit_packing
from ledgerline.llm.personal_data import op12_personal_data
from ledgerline.llm.spelling import op11_spelling_variants
from ledgerline.llm.substring_dedup import op6_substring_dedup
from ledgerline.llm.token_files import op9_token_files
from ledgerline.llm.toxicity import op1_toxicity
from ledgerline.llm.vp_tree import op8_vp_tree
from ledgerline.llm.warc import op5_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_vp_tree": op8_vp_tree,
    "op9_token_files": op9_token_files,
    "op10_bagminhash": op10_bagminhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_personal_data": op12_personal_data,
    "op13_fp_tree_search": op13_fp_tree_search,
}

# The others are tested against brute force, round trips or held-out labels.
ORACLES = {
    "op3_license_scan": license_scan.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_warc": warc.SQL,
    "op8_vp_tree": vp_tree.SQL,
    "op13_fp_tree_search": lexical_search.SQL,
}
