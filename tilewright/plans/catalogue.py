"""All queries of the library, without those of optional subpackages."""

from __future__ import annotations

from collections.abc import Callable

from tilewright.plans import codes, ordered, profile, shapes, stored, tiling, vertices

_GROUPS = (tiling, profile, ordered, shapes, stored, codes, vertices)


def queries() -> dict[str, Callable]:
    return {k: v for g in _GROUPS for k, v in g.C.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for g in _GROUPS for k, v in g.C.sql.items()}
