"""All registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import flagship, kernels, market, more, research  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES

QUERIES["flagship_hourly_volatility"] = flagship.hourly_volatility
ORACLES["flagship_hourly_volatility"] = flagship.HOURLY_VOLATILITY_SQL
