"""All queries of the library, by name."""

from sparkloom.plans import display, evaluation, evidence, guard, lookups, quotes, scoring, streams, text, validation, verdicts  # noqa: F401
from sparkloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
