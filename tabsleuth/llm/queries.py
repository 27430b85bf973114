"""Queries of the training-data operators, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import (q_divergence, q_imatch, q_langid, q_licenses, q_lines, q_mixing, q_neardup, q_packing, q_resample, q_substrings, q_topk,
               q_toxicity, q_warc)

QUERIES = {
    "op1_line_dedup": q_lines.query,
    "op2_toxicity": q_toxicity.query,
    "op3_mixing": q_mixing.query,
    "op4_language_id": q_langid.query,
    "op5_substring_dedup": q_substrings.query,
    "op6_exact_topk": q_topk.query,
    "op7_fingerprints": q_imatch.query,
    "op8_warc": q_warc.query,
    "op9_packing": q_packing.query,
    "op10_near_dedup": q_neardup.query,
    "op11_divergence": q_divergence.query,
    "op12_resample": q_resample.query,
    "op13_licenses": q_licenses.query,
}

ORACLES = {
    "op1_line_dedup": q_lines.SQL,
    "op3_mixing": q_mixing.SQL,
    "op6_exact_topk": q_topk.SQL,
    "op8_warc": q_warc.SQL,
    "op11_divergence": q_divergence.SQL,
    "op12_resample": q_resample.SQL,
    "op13_licenses": q_licenses.SQL,
}
