"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **write) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder (``spark.checkpoint.dir``)
    and read it back: cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    w = df.write.option("compression", write.get("compression", "zstd"))
    if "partition_by" in write:
        w = w.partitionBy(*write["partition_by"])
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if "partition_by" not in write else spark.read.parquet(path)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list[list]], Iterator[dict]]],
             rows: int | None = None) -> DataFrame:
    """``mapInArrow`` over Python columns.

    ``make`` runs once per task (to load vocabularies and open caches); the
    function it returns gets the columns of one Arrow batch as lists (at most
    ``rows`` rows, if given) and yields dicts of output columns (any number of rows).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for whole in batches:
            for batch in pieces_of(whole, rows or whole.num_rows):
                for out in each([c.to_pylist() for c in batch.columns]):
                    yield pa.RecordBatch.from_arrays([
                        out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else
                        pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, types)


def pieces_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows, so few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, max(rows, 1)):
        yield batch.slice(at, rows)


class Cache:
    """Results of short texts, bounded by bytes: two generations, of which the older goes
    when the younger has grown to half of ``limit``; what is asked for again stays."""

    ENTRY = 170  # bytes of an entry of a dict of short ``str`` and ``bytes``, without their characters

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def again(self, key: str) -> bytes | None:
        """The result of a text that is not in ``young``."""
        x = self.old.pop(key, None)
        if x is not None:
            self.add({key: x})
        return x

    def add(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.bytes += self.ENTRY * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        if self.bytes > self.limit // 2:
            self.young, self.old, self.bytes = {}, self.young, 0


def per_worker(key: tuple, make: Callable):
    """An object (vocabulary, bounded cache) that a Python worker keeps from task
    to task; a worker holds one, a new key replaces it."""
    import sys

    held = sys.__dict__.setdefault("_tavola_worker", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def forget() -> None:
    """Give up what ``per_worker`` keeps in this worker."""
    import sys

    sys.__dict__.get("_tavola_worker", {}).clear()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows per Arrow batch for whole texts: texts may be long, so a batch is
    kept to few rows (a batch also ends at Spark's byte limit)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
