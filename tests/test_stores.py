"""Commit markers, staged database writes, compacted views and digest comparison."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tavola.operators import changes as C
from tavola.sources import sinks as S
from tavola.streaming import views as T


# ---- S6: one of two writers commits

def test_only_one_writer_puts_a_marker(spark, tmp_path):
    path = str(tmp_path / "m" / "marker.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: S.put_if_absent(spark, path, f"writer {i}"), range(8)))
    assert won.count(True) == 1
    assert open(path).read() == f"writer {won.index(True)}"
    assert os.listdir(tmp_path / "m") == ["marker.json"]


def test_interleaved_writers_of_a_version(spark, seed, tmp_path, monkeypatch):
    """Both see no marker, both write all tables; the second to commit loses."""
    out = str(tmp_path / "snap")
    one = {"menu": seed["menu"].limit(3)}
    put, late = S.put_if_absent, []

    def other_writer_first(spark_, path, text):
        if not late:
            late.append(True)
            S.write_snapshot({"menu": seed["menu"]}, out, 1)
        return put(spark_, path, text)

    monkeypatch.setattr(S, "put_if_absent", other_writer_first)
    with pytest.raises(FileExistsError):
        S.write_snapshot(one, out, 1)
    assert S.read_snapshot(spark, out, 1, ["menu"])["menu"].count() == 9
    assert [r.version for r in S.committed_versions(spark, out).collect()] == [1]


def test_a_marker_that_is_being_written_commits_nothing(spark, seed, tmp_path):
    out = str(tmp_path / "snap")
    os.makedirs(f"{out}/v=1/_COMMITTED")
    open(f"{out}/v=1/_COMMITTED/marker.json", "w").close()
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, out, 1)
    assert S.latest_version(spark, out) is None


# ---- S5: staged writes (a database in this process)

PROPS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def url(spark):
    return f"jdbc:derby:memory:stores_{os.urandom(4).hex()};create=true"


def table(spark, url, name="T"):
    return sorted(tuple(r) for r in S.read_jdbc(spark, url, name, properties=PROPS).collect())


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "ID int, V int")


def test_a_repeated_write_adds_nothing(spark, url):
    S.write_jdbc(frame(spark, [(1, 1), (2, 2)]), url, "T", properties=PROPS)
    more = frame(spark, [(2, 20), (3, 30)])
    for _ in range(2):
        S.merge_jdbc(more, url, "T", ["ID"], properties=PROPS)
        assert table(spark, url) == [(1, 1), (2, 20), (3, 30)]


def test_repeated_and_lost_attempts_leave_no_row_twice(spark, url):
    """Partition 0 was inserted by two whole attempts, partition 1 by a part of one and by a whole one."""
    S.write_jdbc(frame(spark, [(1, 0), (9, 9)]), url, "T", properties=PROPS)
    staged = [(1, 1, 0, 100), (2, 2, 0, 100), (1, 1, 0, 105), (2, 2, 0, 105), (3, 3, 1, 101), (3, 3, 1, 106), (4, 4, 1, 106)]
    S.write_jdbc(spark.createDataFrame(staged, f"ID int, V int, {S.PART} int, {S.ATTEMPT} long"), url, "STAGED", properties=PROPS)
    S.merge_staged(spark, url, "T", "STAGED", ["ID", "V"], ["ID"], PROPS)
    assert table(spark, url) == [(1, 1), (2, 2), (3, 3), (4, 4), (9, 9)]
    with pytest.raises(Exception):
        table(spark, url, "STAGED")


def test_a_write_that_fails_changes_nothing(spark, url):
    S.write_jdbc(frame(spark, [(1, 1)]), url, "T", properties=PROPS)
    broken = frame(spark, [(2, 2), (3, 3)]).withColumn("V", F.when(F.col("ID") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("V")).cast("int"))
    with pytest.raises(Exception):
        S.merge_jdbc(broken, url, "T", ["ID"], properties=PROPS)
    assert table(spark, url) == [(1, 1)]


def test_reads_are_cut_at_quantiles(spark, url):
    """Most ids are small, one is huge: ranges of equal width would leave all but one empty."""
    data = [(i, i) for i in range(100)] + [(1 << 30, 7), (None, 8)]
    S.write_jdbc(frame(spark, data), url, "T", properties=PROPS)
    df = S.read_jdbc(spark, url, "T", partition_column="ID", num_partitions=4, properties=PROPS)
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert df.count() == 102 and max(sizes) <= 27 and len(sizes) == 5
    names = spark.createDataFrame([("o'hara",), ("b",), ("c",), ("a",)], "NAME string")
    names.write.option("createTableColumnTypes", "NAME VARCHAR(20)").jdbc(url, "N", properties=PROPS)
    back = S.read_jdbc(spark, url, "N", partition_column="NAME", num_partitions=3, properties=PROPS)
    assert sorted(r[0] or "" for r in back.collect()) == ["a", "b", "c", "o'hara"]


# ---- T1-T3: compacted views

def test_a_view_opens_few_files_after_many_batches(spark, tmp_path):
    out = str(tmp_path / "view")
    for b in range(100):
        df = spark.createDataFrame([(b % 7, b), (100 + b, b)], "k int, v int").withColumn("batch_id", F.lit(b).cast("long"))
        df.coalesce(1).write.mode("overwrite").parquet(T._delta(out, b))
        if (b + 1) % T.EVERY == 0:
            T.compact_view(spark, out, "k", b)
        if b == 47:
            T.compact_view(spark, out, "k", b - 8)  # a repeated batch compacts nothing
    view = T.latest_view(spark, out, "k")
    want = {100 + b: b for b in range(100)} | {b % 7: b for b in range(100)}
    assert dict(rows(view, "k", "v")) == want
    files = [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]
    assert len(view.inputFiles()) <= 20 and len(files) <= 60


def test_view_between_bases_and_a_lost_base(spark, tmp_path):
    out = str(tmp_path / "view")
    for b in range(13):
        spark.createDataFrame([(b % 3, b)], "k int, v int").withColumn("batch_id", F.lit(b).cast("long")).write.parquet(T._delta(out, b))
        if b == 9:
            os.makedirs(f"{out}/base/b={b:012d}-lost")  # an attempt that never got its marker
            T.compact_view(spark, out, "k", b)
    assert dict(rows(T.latest_view(spark, out, "k"), "k", "v")) == {0: 12, 1: 10, 2: 11}


def test_state_in_rocksdb(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    from tavola.session import DEFAULT_CONF
    old = spark.conf.get(name)
    spark.conf.set(name, DEFAULT_CONF[name])
    try:
        spark.createDataFrame([(1, 1, 5), (2, 1, 6), (1, 1, 5)], "line_id int, order_id int, amount int").write.parquet(str(tmp_path / "in"))
        stream = T.change_stream(spark, str(tmp_path / "in"), "line_id int, order_id int, amount int")
        got = T.run_to_completion(spark, T.stream_order_bill(stream), "order_id", "rocks")
        assert [(r["order_id"], str(r["bill"]), r["n_lines"]) for r in got.collect()] == [(1, "11.00", 2)]
    finally:
        spark.conf.set(name, old)


# ---- C16: digests of buckets

def test_audit_by_digests(spark, monkeypatch):
    monkeypatch.setattr(C, "DIGESTS", 64)
    old = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v"))
    new = old.withColumn("v", F.when(F.col("key").isin("k5", "k7"), F.lit("changed")).when(F.col("key") == "k6", None).otherwise(F.col("v")))
    new = new.filter("key <> 'k100'").unionByName(spark.createDataFrame([("new", "x")], "key string, v string"))
    got = rows(C.change_audit(old, new, "key", "v"), "key", "old_value", "new_value")
    assert got == [("k5", "5", "changed"), ("k6", "6", None), ("k7", None, "changed")]
    buckets = C.differing_buckets(old, new, "key", "v").count()
    assert 1 <= buckets <= 5 and C.differing_buckets(old, old, "key", "v").count() == 0
    swapped = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, v string")
    other = spark.createDataFrame([("a", "2"), ("b", "1")], "key string, v string")
    assert rows(C.change_audit(swapped, other, "key", "v"), "key") == [("a",), ("b",)]


def test_untouched_rows_are_not_joined(spark):
    old = spark.range(50_000).select("id", F.col("id").alias("v"))
    new = old.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v")))
    df = C.change_audit(old, new, "id", "v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and df.count() == 1
    assert C.differing_buckets(old, new, "id", "v").count() == 1


# ---- C6: lines of untouched baskets pass

def test_untouched_baskets_are_not_rewritten(spark, seed, monkeypatch):
    name = seed["menu"].orderBy("menu_id").first()["item_name"]
    ask = spark.createDataFrame([(1, "I001", [(name, 2)]), (2, "I999", [(name, 1)])],
                                "request_seq long, item_id string, items array<struct<item_name:string,quantity:int>>")
    want = None
    for bits in (20, 0):  # 0: one slot, so every basket may be touched
        monkeypatch.setattr(C, "TOUCH_BITS", bits)
        items = C.apply_basket_lines(seed, ask).tables["items"]
        assert want is None or rows(items) == want
        want = rows(items)
    monkeypatch.setattr(C, "TOUCH_BITS", 20)
    touched = spark.createDataFrame([("I001",)], "item_id string")
    assert C._touched_only(seed["items"], touched).count() == 1
    assert C._touched_only(seed["items"], touched, inside=False).count() == 6
