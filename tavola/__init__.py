"""tavola: restaurant ordering and delivery analytics as PySpark DataFrame jobs.

Every public function takes a dict of DataFrames keyed by table name (``t``)
and returns a lazy DataFrame; nothing is collected to the driver.
"""

from tavola.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
