"""Registered queries over the star-schema tables, each with its SQL where SQL can say it."""

from tidemark.plans import analysis, composed, exogenous, forecasts, learned, relational, transforms
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "composed", "exogenous", "forecasts", "learned", "relational", "transforms"]
