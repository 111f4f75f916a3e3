"""Imports every query module, which fills the catalogue."""

from riskframe.plans import q_windows, q_core, q_relational, q_scalar, q_analytics, q_backtest, q_portfolio, q_text, q_ml, q_streaming, q_api  # noqa: F401, I001
from riskframe.plans.sqlkit import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
