"""The corpus operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name: module that holds it.
OPERATORS = {
    "op1_toxicity": "toxicity",
    "op2_html_template": "html_template",
    "op3_line_templates": "line_templates",
    "op4_token_store": "token_store",
    "op5_quality_rff": "quality_rff",
    "op6_quality_votes": "quality_votes",
    "op7_best_fit_packing": "packing",
    "op8_license_scan": "license_scan",
    "op9_simhash": "simhash",
    "op10_decontaminate": "decontaminate",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {}
