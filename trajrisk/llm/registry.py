"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    decontamination, hidden_markov, html_text, license_scan, near_dedup, packing, pieces, quality_classifier, quality_rules, ranked_search, substring_dedup, token_alignment, warc,
)

MODULES = [quality_classifier, warc, pieces, license_scan, decontamination, hidden_markov, quality_rules, html_text, near_dedup, substring_dedup, token_alignment, packing, ranked_search]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
