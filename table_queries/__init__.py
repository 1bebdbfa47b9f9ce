"""One registered query per operator, with the SQL that gives the same result.

Every query reads the given tables whole.  Texts and files that the operators
need are derived from those tables by Spark.
"""

from table_queries.registry import ORACLES, QUERIES

from table_queries import (  # noqa: F401  (registers the queries)
    cleaning,
    filters,
    patterns,
    profiles,
    rules,
    scans,
    sources,
    tables,
)

__all__ = ["ORACLES", "QUERIES"]
