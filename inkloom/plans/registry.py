"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from inkloom.plans import base, books, payloads, people, questions, sources, states, stores, stories  # noqa: F401

FLAGSHIP = "training_rows"


def queries() -> dict[str, Callable]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
