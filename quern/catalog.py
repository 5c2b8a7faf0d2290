"""All registered engine queries and their DuckDB SQL."""

from quern.plans import learning, service, tables, vectors  # noqa: F401  they register themselves
from quern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
