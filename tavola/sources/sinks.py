"""Cart source, JSON reports, versioned snapshots, relational tables.

Snapshots replace transactions: a change batch writes every touched table
into a new version folder and puts the ``_COMMITTED`` marker there last, if no other
writer has, so a reader never sees half a batch and one of two writers loses.
A path that is being read is never overwritten. Writes to a database are staged and
merged by key, so a repeated task or a repeated write adds no row twice.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavola.schema import SCHEMAS
from tavola.session import written
from tavola.sources.tables import Tables

CART_SCHEMA = T.StructType([
    T.StructField("request_seq", T.LongType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("item_name", T.StringType()),
                                                     T.StructField("quantity", T.IntegerType())]))),
    T.StructField("payment_method", T.StringType()),
])


def read_carts(spark: SparkSession, path: str) -> DataFrame:
    """S3: cart payloads from JSON lines (schema given, never inferred)."""
    return spark.read.schema(CART_SCHEMA).json(path)


def cart_lines_of(carts: DataFrame) -> DataFrame:
    """Flatten cart payloads to one row per line (line numbers from 1)."""
    return (carts.select("request_seq", "customer_id", "payment_method", F.posexplode("items").alias("pos", "it"))
            .select("request_seq", "customer_id", "payment_method", (F.col("pos") + 1).alias("line_no"),
                    F.col("it.item_name").alias("item_name"), F.col("it.quantity").alias("quantity")))


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A (possibly nested) report as JSON lines."""
    df.write.mode(mode).json(path)


def report_json_text(df: DataFrame, name: str = "json") -> DataFrame:
    """S4 as a column: each row rendered with ``to_json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_snapshot(t: Tables, out_dir: str, version: int) -> str:
    """Write ``t`` as version ``version`` of a snapshot folder.

    The tables go to a folder of this attempt, ``<out_dir>/v=<version>/<attempt>``;
    the marker written after all tables names it. A crashed attempt leaves no
    marker and does not block the next one; a committed version stays as it is.
    """
    base = f"{out_dir.rstrip('/')}/v={version}"
    spark = next(iter(t.values())).sparkSession
    if _attempt(spark, out_dir, version) is not None:
        raise FileExistsError(f"version {version} is committed")
    attempt = uuid.uuid4().hex
    for name, df in t.items():
        df.write.mode("errorifexists").parquet(f"{base}/{attempt}/{name}.parquet")
    if not put_if_absent(spark, f"{base}/_COMMITTED/marker.json", json.dumps({"version": version, "attempt": attempt}) + "\n"):
        raise FileExistsError(f"version {version} was committed by another writer")
    return f"{base}/{attempt}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that nobody else has created; False when it exists.

    A store that creates without overwriting in one step decides who was first
    (HDFS and the like). On a plain file system the whole file is linked to its
    name, which fails when the name is taken. A file that is still empty is one
    that is being written: readers of markers take no row from it."""
    jvm, p, fs = _file_system(spark, path)
    fs.mkdirs(p.getParent())
    data = bytearray(text.encode())
    try:
        if fs.getUri().getScheme() == "file":
            files, target = jvm.java.nio.file.Files, jvm.java.io.File(p.toUri().getPath()).toPath()
            draft = target.resolveSibling(f".{uuid.uuid4().hex}")
            none = spark._sc._gateway.new_array(jvm.java.nio.file.OpenOption, 0)
            files.write(draft, data, none)
            try:
                files.createLink(target, draft)
            finally:
                files.deleteIfExists(draft)
        else:
            out = fs.create(p, False)
            try:
                out.write(data)
            finally:
                out.close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (few by construction); none when it is not there."""
    _, p, fs = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    _, p, fs = _file_system(spark, path)
    fs.delete(p, True)


MARKER = "version long, attempt string"


def committed_versions(spark: SparkSession, out_dir: str) -> DataFrame:
    """Versions whose commit marker exists (read as data, not listed on the driver)."""
    return spark.read.schema(MARKER).json(f"{out_dir.rstrip('/')}/v=*/_COMMITTED")


def _first_or_none(df_of):
    """The first row of a frame; None when its path does not exist yet."""
    try:
        return df_of().first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _attempt(spark: SparkSession, out_dir: str, version: int) -> str | None:
    marker = f"{out_dir.rstrip('/')}/v={version}/_COMMITTED"
    row = _first_or_none(lambda: spark.read.schema(MARKER).json(marker))
    return None if row is None else row["attempt"]


def read_snapshot(spark: SparkSession, out_dir: str, version: int, names=None) -> Tables:
    """Tables of one committed version; a version without a marker is refused."""
    attempt = _attempt(spark, out_dir, version)
    if attempt is None:
        raise FileNotFoundError(f"version {version} is not committed in {out_dir}")
    base = f"{out_dir.rstrip('/')}/v={version}/{attempt}"
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{base}/{n}.parquet") for n in (names or SCHEMAS)}


@contextmanager
def _connection(spark: SparkSession, url: str, properties: dict | None):
    """A connection of the driver's own, for statements that return little."""
    props = spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        props.setProperty(k, str(v))
    c = spark._jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        yield c
    except BaseException:
        if not c.getAutoCommit():
            c.rollback()
        raise
    finally:
        c.close()


def _quoted(connection, name: str) -> str:
    """A column name as the database wants it (Spark writes names quoted, too)."""
    mark = connection.getMetaData().getIdentifierQuoteString().strip()
    return f"{mark}{name}{mark}"


def _rows(connection, sql: str, width: int) -> list[tuple]:
    found, statement = [], connection.createStatement()
    result = statement.executeQuery(sql)
    while result.next():
        found.append(tuple(result.getString(i + 1) for i in range(width)))
    statement.close()
    return found


def quantile_predicates(spark: SparkSession, url: str, table: str, column: str, parts: int = 8,
                        properties: dict | None = None) -> list[str]:
    """Conditions that cut ``table`` into ``parts`` ranges of ``column`` with about equally many
    rows (equal values stay together), and one for its nulls. The column may be numeric or text."""
    with _connection(spark, url, properties) as c:
        column = _quoted(c, column)
        n = int(_rows(c, f"SELECT COUNT({column}) FROM {table}", 1)[0][0])
        cuts = []
        for i in range(1, parts):
            at = n * i // parts
            cuts += _rows(c, f"SELECT {column} FROM {table} WHERE {column} IS NOT NULL ORDER BY {column} "
                             f"OFFSET {at} ROWS FETCH NEXT 1 ROWS ONLY", 1) if at < n else []
        meta = c.createStatement().executeQuery(f"SELECT {column} FROM {table} WHERE 1 = 0").getMetaData()
        text = not spark._jvm.java.lang.Class.forName("java.lang.Number").isAssignableFrom(
            spark._jvm.java.lang.Class.forName(meta.getColumnClassName(1)))
    values = list(dict.fromkeys(("'" + v.replace("'", "''") + "'") if text else v for v, in cuts))
    if not values:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(values, values[1:])]
    return [f"{column} < {values[0]}", *inner, f"{column} >= {values[-1]}", f"{column} IS NULL"]


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              num_partitions: int = 8, properties: dict | None = None) -> DataFrame:
    """Read a relational table; with a ``partition_column`` the read is split into
    about ``num_partitions`` range queries of equally many rows, whatever the values' spread."""
    props = dict(properties or {})
    if partition_column is not None:
        parts = quantile_predicates(spark, url, table, partition_column, num_partitions, props)
        return spark.read.jdbc(url, table, predicates=parts, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None,
               batch_size: int = 10000) -> None:
    """Write a table through JDBC (batched inserts per partition), as it is: for new
    tables. A task that is repeated may insert its rows again; ``merge_jdbc`` does not."""
    props = {"batchsize": str(batch_size), **(properties or {})}
    df.write.jdbc(url, table, mode=mode, properties=props)


PART, ATTEMPT = "stage_part", "stage_attempt"


def _with_attempt(df: DataFrame) -> DataFrame:
    """The rows of each task, marked with its partition and its attempt."""
    import pyarrow as pa
    from pyspark import TaskContext

    def mark(batches):
        task = TaskContext.get()
        for b in batches:
            part = pa.array([task.partitionId()] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, part, pa.array([task.taskAttemptId()] * b.num_rows, pa.int64())],
                                             names=[*b.schema.names, PART, ATTEMPT])

    schema = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(ATTEMPT, T.LongType())])
    return df.mapInArrow(mark, schema)


def merge_staged(spark: SparkSession, url: str, table: str, stage: str, columns: list[str], key: list[str],
                 properties: dict | None = None) -> None:
    """Merge a staged table into ``table`` by ``key`` in one transaction, then drop it.

    Of each partition one complete attempt counts (the one with most rows; the others
    were lost on the way or repeated). Rows with a staged key are replaced, others added."""
    with _connection(spark, url, properties) as c:
        c.setAutoCommit(False)
        run = c.createStatement().executeUpdate
        part, attempt = _quoted(c, PART), _quoted(c, ATTEMPT)
        # One row for each task: what a job has of them, the driver can hold.
        best: dict[str, tuple[int, int]] = {}
        seen = [(p, int(a), int(n)) for p, a, n in _rows(
            c, f"SELECT {part}, {attempt}, COUNT(*) FROM {stage} GROUP BY {part}, {attempt}", 3)]
        for p, a, n in seen:
            best[p] = max(best.get(p, (0, 0)), (n, -a))
        for p, a, n in seen:
            if best[p] != (n, -a):
                run(f"DELETE FROM {stage} WHERE {part} = {p} AND {attempt} = {a}")
        same = " AND ".join(f"s.{k} = {table}.{k}" for k in (_quoted(c, k) for k in key))
        run(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same})")
        names = ", ".join(_quoted(c, n) for n in columns)
        run(f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}")
        run(f"DROP TABLE {stage}")
        c.commit()


def merge_jdbc(df: DataFrame, url: str, table: str, key: list[str], properties: dict | None = None,
               batch_size: int = 10000) -> None:
    """Insert or replace the rows of ``df`` (one for each ``key``) in an existing table.

    The rows are staged in a table of this write with the task attempt that inserted
    them, then merged by key in one transaction: whatever is repeated, a task or the whole
    write, no row is there twice, and a write that fails leaves the table as it was. Keys must not be null."""
    spark = df.sparkSession
    stage = f"stage_{uuid.uuid4().hex[:20]}"
    rows = written(df, "jdbc-stage")  # a repeated task inserts the same rows
    props = {"batchsize": str(batch_size), **(properties or {})}
    _with_attempt(rows).write.jdbc(url, stage, mode="errorifexists", properties=props)
    merge_staged(spark, url, table, stage, df.columns, key, properties)


def latest_version(spark: SparkSession, out_dir: str) -> int | None:
    """Highest committed version number (one scalar; None when nothing is committed)."""
    row = _first_or_none(lambda: committed_versions(spark, out_dir).agg(F.max("version").alias("v")))
    return None if row is None else row["v"]


def publish_batch(base: Tables, result, out_dir: str, version: int) -> str:
    """S6 for a change batch: the touched tables from ``result.tables``, the
    untouched ones from ``base`` and the verdicts, written as one version
    (verdicts and tables first, the commit marker last) to the returned folder.
    ``base`` is read from an older version, so no path is overwritten."""
    tables = {n: result.tables.get(n, base[n]) for n in SCHEMAS}
    return write_snapshot({"_verdicts": result.verdicts, **tables}, out_dir, version)  # commit marker last


def carts_from_json_text(df: DataFrame, col: str = "payload") -> DataFrame:
    """cart payloads held as JSON text in a column, parsed with the cart
    schema (``from_json``; malformed text gives NULL fields)."""
    parsed = F.from_json(F.col(col), CART_SCHEMA)
    return df.select(parsed.alias("_c")).select("_c.*")
