"""All queries of this library but the training-data ones; importing the modules registers them."""

from lumenledger.jobs import corpus, governance, memory, search  # noqa: F401
from lumenledger.jobs.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
