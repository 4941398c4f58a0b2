"""All queries of the library."""

from __future__ import annotations

from quire.plans import codecs, content, coverage, documents, pixels, resources, shadings, tables  # noqa: F401  (they register their queries)
from quire.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
