"""The registered queries and their oracles; importing a plan module registers its queries."""

from __future__ import annotations

from tidemark.plans import choices, forecasts, hotkeys, longlived, models, more, panel, quant, relational, rest, risks  # noqa: F401
from tidemark.plans.panel import ORACLES, QUERIES

flagship = QUERIES["brand_week_returns"]
