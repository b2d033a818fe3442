"""Registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from rainloom.llm import (
    bpe, collocations, decontaminate, fill_middle, host_rules, html_text, language_model, line_dedup, near_dedup, pii, secrets,
    toxicity, url_filter,
)

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_minhash_dedup": near_dedup.op2,
    "op3_suffix_decontamination": decontaminate.op3,
    "op4_stupid_backoff": language_model.op4,
    "op5_compression_toxicity": toxicity.op5,
    "op6_text_density": html_text.op6,
    "op7_semi_markov_pii": pii.op7,
    "op8_host_rules": host_rules.op8,
    "op9_url_filter": url_filter.op9,
    "op10_byte_bpe": bpe.op10,
    "op11_fill_in_middle": fill_middle.op11,
    "op12_line_dedup": line_dedup.op12,
    "op13_collocations": collocations.op13,
}
ORACLES: dict[str, str] = {
    "op2_minhash_dedup": near_dedup.SQL,
    "op3_suffix_decontamination": decontaminate.SQL,
    "op4_stupid_backoff": language_model.SQL,
    "op8_host_rules": host_rules.SQL,
    "op11_fill_in_middle": fill_middle.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_collocations": collocations.SQL,
}
