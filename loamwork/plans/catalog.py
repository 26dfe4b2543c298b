"""All registered queries and their SQL."""

from loamwork.plans import more  # noqa: F401  registers its queries
from loamwork.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
