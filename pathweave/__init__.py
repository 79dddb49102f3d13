"""pathweave: product-analytics roll-ups (web + mobile game) as Spark DataFrame operators.

Every operator is a plain function ``f(df, ..., **params) -> DataFrame`` built from
built-in Spark SQL expressions, so Catalyst and adaptive execution plan the work.
"""

from pathweave.config import JobParams, resolve_cutoffs  # noqa: F401
from pathweave.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["JobParams", "resolve_cutoffs", "get_spark", "checkpoint_dir"]
