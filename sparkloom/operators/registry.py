"""All registered operators of the engine: name -> DataFrame builder, name -> equivalent SQL."""

from __future__ import annotations

from ..functions import conditional, math, nested, strings, temporal
from ..plans import owned
from ..streaming import batch_equivalents
from . import aggregates, filters, joins, ordering, sets, windows
from .base import Query

_ALL = (filters, ordering, aggregates, joins, sets, windows, strings, math, temporal, nested, conditional, owned, batch_equivalents)


def queries() -> dict[str, Query]:
    return {name: q for m in _ALL for name, q in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _ALL for name, q in m.R.oracles.items()}
