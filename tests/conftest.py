import os
import sys
import tempfile

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    ckpt = tempfile.mkdtemp(prefix="tavola-test-ckpt-", dir="/tmp")
    s = (SparkSession.builder.master("local[4]").appName("tavola-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from tavola.sources.tables import seed_tables
    return seed_tables(spark)


def rows(df, *cols):
    """Collected rows as tuples, sorted (for order-insensitive asserts)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
