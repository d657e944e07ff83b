"""The polled live views as Structured Streaming queries.

The source pages poll every 30 seconds; here each view is a streaming
aggregation started with ``trigger(processingTime='30 seconds')`` (or
``availableNow`` to drain what is there, as tests do). Results go through
``foreachBatch`` to a view folder: the changed keys of each batch (a delta), and now
and then a base, into which the deltas so far are merged by key. ``latest_view``
reads the newest base and the deltas after it, so what it opens does not grow with the
number of batches. Nothing is gathered on the driver.

State: T1 and T3 keep one row per key; T2 remembers the ids of all lines, or (with a
watermark) those of a period. Sessions of ``get_spark`` keep state in RocksDB, so it
may exceed an executor's memory.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tavola.session import scratch_path
from tavola.sources.sinks import _first_or_none, folder_names, put_if_absent, remove_folder


def change_stream(spark: SparkSession, directory: str, schema, file_glob: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a folder of parquet change files (schema given)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def live_order_board(stream: DataFrame, key: str = "order_id", status: str = "status", ts: str = "ts",
                     tie: str | None = None) -> DataFrame:
    """Latest status per key (ties on ``ts`` broken by ``tie``)."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    return stream.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(ts).alias("last_ts"),
                                   F.count(F.lit(1)).alias("n_events"))


def stream_order_bill(stream: DataFrame, key: str = "order_id", line: str = "line_id", amount: str = "amount",
                      ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Running bill per key; re-sent lines (same ``line`` id) count once.

    By default every line counts, however late; the state keeps the ids of all
    lines. With ``watermark`` (such as "30 days") ids are forgotten that long
    after their event time, and later lines are dropped.
    """
    if watermark is None:
        deduped = stream.dropDuplicates([line])
    else:
        # Watermarks need a zoned timestamp; zone-less event times are read as UTC.
        timed = stream.withColumn("_event_time", F.col(ts).cast("timestamp"))
        deduped = timed.withWatermark("_event_time", watermark).dropDuplicatesWithinWatermark([line])
    return deduped.groupBy(key).agg(F.sum(F.col(amount).cast("decimal(18,2)")).cast("decimal(38,2)").alias("bill"),
                                    F.count(F.lit(1)).alias("n_lines"))


def stream_courier_rating(stream: DataFrame, key: str = "delivery_person_id", rating: str = "rating") -> DataFrame:
    """Running mean rating per courier, kept as exact sum and count."""
    r = F.col(rating).cast("decimal(18,2)")
    return stream.groupBy(key).agg(F.count(r).alias("rating_count"), F.sum(r).cast("decimal(38,2)").alias("rating_sum"),
                                   F.try_divide(F.sum(r).cast("double"), F.count(r).cast("double")).alias("mean_rating"))


EVERY = 10          # batches from one base to the next
DELTA_FILES = 4     # files of a delta at most


def _delta(out_dir: str, batch_id: int) -> str:
    return f"{out_dir}/delta/b={batch_id:012d}"


def _base_of(spark: SparkSession, out_dir: str) -> tuple[int, str | None]:
    """Batch and folder of the newest base; (-1, None) before there is one."""
    row = _first_or_none(lambda: spark.read.schema("batch long, folder string").json(f"{out_dir}/bases").orderBy(F.desc("batch")))
    return (-1, None) if row is None else (row["batch"], row["folder"])


def compact_view(spark: SparkSession, out_dir: str, key: str, batch_id: int) -> None:
    """Merge the newest base and the deltas up to ``batch_id`` into a new base.

    The base is written to a folder of this attempt, then named by a marker that only one
    writer can put. What the base before it had taken in goes (readers of
    that base keep its own files and the deltas after it)."""
    before, old = _base_of(spark, out_dir)
    if before >= batch_id:
        return
    folder = f"{out_dir}/base/b={batch_id:012d}-{uuid.uuid4().hex}"
    view = latest_view(spark, out_dir, key, upto=batch_id, with_batch=True)
    view.write.parquet(folder)
    if not put_if_absent(spark, f"{out_dir}/bases/b{batch_id:012d}.json", json.dumps({"batch": batch_id, "folder": folder}) + "\n"):
        remove_folder(spark, folder)
        return
    if old is None:
        return
    done = spark.read.schema("batch long, folder string").json(f"{out_dir}/bases").filter(F.col("batch") < before)
    for r in done.collect():  # at most the bases since the last removal: one
        remove_folder(spark, r["folder"])
        remove_folder(spark, f"{out_dir}/bases/b{r['batch']:012d}.json")
    for b in range(max(0, before - 2 * EVERY), before + 1):
        remove_folder(spark, _delta(out_dir, b))


def start_view(view: DataFrame, out_dir: str, checkpoint: str, available_now: bool = False,
               interval: str = "30 seconds", key: str | None = None) -> StreamingQuery:
    """Run an aggregating view in update mode; each micro-batch's changed rows
    become a delta of ``out_dir``. With ``key`` every ``EVERY``th batch makes a new base."""
    out_dir = out_dir.rstrip("/")

    def sink(df: DataFrame, batch_id: int) -> None:
        # A batch that is repeated overwrites its own delta with the same rows.
        (df.withColumn("batch_id", F.lit(batch_id).cast("long")).repartition(DELTA_FILES)
         .write.mode("overwrite").parquet(_delta(out_dir, batch_id)))
        if key is not None and (batch_id + 1) % EVERY == 0:
            compact_view(df.sparkSession, out_dir, key, batch_id)

    w = view.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def latest_view(spark: SparkSession, out_dir: str, key: str, upto: int | None = None, with_batch: bool = False) -> DataFrame:
    """Current view = for each key its row from the latest batch, from the newest base and
    the deltas after it."""
    out_dir = out_dir.rstrip("/")
    since, folder = _base_of(spark, out_dir)
    schema = spark.read.parquet(folder).schema if folder else None
    deltas = spark.read.option("basePath", f"{out_dir}/delta")
    names = [f"{out_dir}/delta/b={b:012d}" for b in _delta_batches(spark, out_dir) if b > since and (upto is None or b <= upto)]
    parts = [deltas.parquet(*names).drop("b")] if names else []
    parts += [spark.read.schema(schema).parquet(folder)] if folder else []
    if not parts:
        raise FileNotFoundError(f"no view in {out_dir}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    value_cols = [c for c in rows.columns if c not in (key, "batch_id")]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*value_cols, "batch_id"), "batch_id").alias("_v"))
            .select(key, *[F.col(f"_v.{c}").alias(c) for c in value_cols], *([F.col("_v.batch_id")] if with_batch else [])))


def _delta_batches(spark: SparkSession, out_dir: str) -> list[int]:
    """Numbers of the deltas that are there: those since the base before the newest."""
    return sorted(int(n.removeprefix("b=")) for n in folder_names(spark, f"{out_dir}/delta") if n.startswith("b="))


def run_to_completion(spark: SparkSession, view: DataFrame, key: str, name: str) -> DataFrame:
    """Drain the stream once (``availableNow``) into a fresh folder under the
    shared checkpoint directory and return the resulting view."""
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    q = start_view(view, f"{base}/out", f"{base}/checkpoint", available_now=True, key=key)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return latest_view(spark, f"{base}/out", key)
