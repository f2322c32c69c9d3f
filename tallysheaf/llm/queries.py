"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, centroids, exact_dedup, html, jaccard, media, neighbours, packing, quality, repeats, rowpattern, toxicity, warc

_MODULES = [exact_dedup, bpe, jaccard, toxicity, warc, packing, quality, media, repeats, html, neighbours, rowpattern, centroids]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and callable(f) and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE", {}).items()}
