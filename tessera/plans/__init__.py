"""Named queries over the corpus tables, with DuckDB SQL for each that SQL can express."""

from tessera.plans import relations, texts  # noqa: F401  they register their queries
from tessera.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
