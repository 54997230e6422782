"""All registered queries."""

from __future__ import annotations

from evalgrid.plans import (  # noqa: F401 - imported to register
    grade_queries,
    pair_queries,
    publish_queries,
    registry,
    run_queries,
    score_queries,
    store_queries,
    version_queries,
)

def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
