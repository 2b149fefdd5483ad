"""All registered queries of the library, without the training-data operators."""

from __future__ import annotations

from .plans import event_study, filings, maintenance, prices, relational, reports, scalars, streams, technical, trades  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

#: Trades after every event, by as-of and range joins, and their metrics by class: it has rows on the smallest tables too.
flagship = QUERIES["AGG-12"]

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
