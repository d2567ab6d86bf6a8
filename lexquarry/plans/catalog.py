"""The registered queries over the star-schema, event, document and vector tables."""

from __future__ import annotations

from collections.abc import Callable

from lexquarry.plans import base, evaluation, extra, more, retrieval, selection

FLAGSHIP = "retrieval_f1"
MODULES = (retrieval, selection, evaluation, extra, more)


def queries() -> dict[str, Callable]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
