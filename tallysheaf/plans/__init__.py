"""Registered queries over the driver tables, each with its SQL where SQL can say it."""

from . import budget, classifier, dataset, hierarchy, matching, pages, reports, texts  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
