"""All queries of this library and the SQL of those that SQL can express."""

from gridweave.plans import data, evaluation  # noqa: F401  they register their queries
from gridweave.plans.fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
