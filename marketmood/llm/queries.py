"""Registered queries of the training-data operators."""

from __future__ import annotations

from marketmood.llm import (cross_polytope, decontamination, html_template, minhash, packing, secret_scan, sharding,
                            simhash, toxicity, url_filter, vector_codes, warc, whitening)

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_minhash": minhash.op5_minhash,
    "op6_html_extraction": html_template.op6_html_extraction,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_sharding": sharding.op9_sharding,
    "op10_simhash": simhash.op10_simhash,
    "op11_whitening": whitening.op11_whitening,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_cross_polytope": cross_polytope.op13_cross_polytope,
}

# The other operators rest on models, hashes or layouts that DuckDB lacks; tests/llm holds them to brute force.
ORACLE_SQL = {"op4_warc": warc.OP4_SQL, "op7_decontamination": decontamination.OP7_SQL,
              "op12_vector_codes": vector_codes.OP12_SQL}
