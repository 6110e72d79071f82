"""spendlens: customer-spending analytics as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame`` and stays lazy
unless a statistic has to become a literal (fitted state, bucket boundaries).
"""

from spendlens.session import checkpoint_dir, get_spark  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
