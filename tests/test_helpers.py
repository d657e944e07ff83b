"""Row numbering, key helpers and validation rules on small fixtures."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from tavola.functions.keys import allocate_keys, max_key, pad_key, random_order_code, with_row_number
from tavola.operators import validate as V


def test_row_numbers_dense_and_ordered(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = with_row_number(df.repartition(11), [F.col("k").asc()], "rn")
    pairs = rows(got, "k", "rn")
    assert pairs == [(k, k + 1) for k in range(5000)]


def test_pad_key_does_not_truncate(spark):
    df = spark.createDataFrame([(5,), (42,), (1000,), (123456,)], "n long")
    assert [r[0] for r in df.select(pad_key("O", F.col("n"))).collect()] == ["O005", "O042", "O1000", "O123456"]


def test_allocate_keys_after_max(spark, seed):
    start = max_key(seed["orders"], "order_id").first().max_key
    req = spark.createDataFrame([(30,), (10,), (20,)], "request_seq long")
    got = rows(allocate_keys(req, "O", start, [F.col("request_seq").asc()], "order_id"))
    assert got == [(10, "O008"), (20, "O009"), (30, "O010")]


def test_order_code_shape(spark, seed):
    codes = [r.order_code for r in random_order_code(seed["orders"], "order_id").collect()]
    assert all(len(c) == 6 and c[:3].isalpha() and c[3:].isdigit() and "Z" not in c[:3] for c in codes)


def test_validation_finds_planted_faults(spark, seed):
    t = dict(seed)
    bad_c = spark.createDataFrame([("C011", "Bad", "not-an-email", "12345", "x"),
                                   ("C001", "Dup", "dup@x.com", "7000000000", "y")], t["customer"].schema)
    t["customer"] = t["customer"].unionByName(bad_c)
    bad_i = spark.createDataFrame([("I099", "M404", 150, Decimal("1.00"))], t["items"].schema)
    t["items"] = t["items"].unionByName(bad_i)
    v = {(r.table_name, r.row_key, r.rule) for r in V.validate(t).collect()}
    assert ("customer", "C011", "regex:email") in v
    assert ("customer", "C011", "regex:phone_number") in v
    assert ("customer", "C001", "duplicate_key") in v
    assert ("items", "I099/M404", "range:quantity") in v
    assert ("items", "I099/M404", "fk:menu_id") in v
    assert ("items", "I099", "orphan_basket") in v


def test_seed_is_clean_except_known(seed):
    v = {(r.rule) for r in V.validate(seed).collect()}
    assert v == set(), v


def test_cart_line_checks(spark):
    lines = spark.createDataFrame([(1, 1, "", "12.5", 1), (1, 2, "Tea", "abc", 2), (2, 1, "Tea", "3", None)],
                                  "request_seq long, line_no int, item_name string, price string, quantity int")
    got = rows(V.validate_cart_lines(lines))
    assert got == [(1, 1, "missing_name"), (1, 2, "bad_price"), (2, 1, "bad_quantity")]


def test_db_timestamp_and_text_helpers(spark):
    import datetime as dt
    from tavola.functions.exprs import clamp_quantity, db_timestamp, full_stars, js_or, payment_status_for, slug
    df = spark.createDataFrame([("2024-03-25 14:30:00", "x", "Cash", 0, 4.2), ("bad", "12", "UPI", 5, None)],
                               "t string, q string, m string, a int, s double")
    got = df.select(db_timestamp("t").alias("ts"), db_timestamp(F.substring("t", 1, 10), "yyyy-MM-dd").alias("d"),
                    clamp_quantity("q").alias("q"), payment_status_for("m").alias("p"), js_or("a", F.lit(9)).alias("a"),
                    full_stars("s").alias("s"), slug(F.lit("  Veg  Starter ")).alias("g")).collect()
    assert got[0].ts == dt.datetime(2024, 3, 25, 14, 30) and got[0].d == dt.datetime(2024, 3, 25)
    assert got[1].ts is None
    assert (got[0].q, got[1].q) == (1, 12)
    assert (got[0].p, got[1].p) == ("Pending", "Completed")
    assert (got[0].a, got[1].a) == (9, 5)
    assert (got[0].s, got[1].s) == (5, 0)  # no score: no full star, as on the page
    assert got[0].g == "veg-starter"


def test_broadcast_only_when_estimate_is_small(spark):
    from tavola.functions.exprs import broadcast_if_small, plan_size_bytes
    small = spark.range(0, 2).withColumnRenamed("id", "k")
    big = spark.range(0, 10 ** 9).withColumnRenamed("id", "k")
    unknown = spark.createDataFrame([(1,), (2,)], "k int")  # no size estimate: never broadcast

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert plan_size_bytes(small) < 1024
    assert hinted(broadcast_if_small(small))
    assert not hinted(broadcast_if_small(big, max_bytes=1024))
    assert not hinted(broadcast_if_small(unknown))


def test_no_bound_for_plans_that_make_rows(spark, tmp_path):
    from tavola.functions.exprs import plan_size_bytes
    small = spark.createDataFrame([(1,)], "k int").coalesce(1)
    small.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert plan_size_bytes(stored.select("k").filter("k > 0")) is None  # see the test below
    assert plan_size_bytes(spark.range(3).filter("id > 0").select(F.col("id").alias("k"))) is not None
    assert plan_size_bytes(spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("k"))) is None
    many = F.explode(F.sequence(F.lit(1), F.lit(100000)))
    assert plan_size_bytes(stored.select(many.alias("k"))) is None
    assert plan_size_bytes(spark.range(3).select(many.alias("k"))) is None
    assert plan_size_bytes(stored.join(stored.withColumnRenamed("k", "j"))) is None


def test_a_small_file_is_no_bound(spark, tmp_path):
    """Constant texts take next to nothing in a file, whatever they take in memory."""
    from tavola.functions.exprs import broadcast_if_small
    path = str(tmp_path / "t")
    spark.range(200_000).select("id", F.repeat(F.lit("x"), 2000).alias("text")).coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    assert "broadcast" not in broadcast_if_small(stored)._jdf.queryExecution().analyzed().toString().lower()


def test_search_folds_letters_beyond_ascii(spark):
    from tavola.functions.exprs import case_insensitive_match
    df = spark.createDataFrame([("CRÈME",), ("Brûlée",), ("tea",)], "name string")
    assert df.filter(case_insensitive_match("name", "crème")).count() == 1


def test_status_filter_ignores_case(spark, seed):
    from tavola.operators.reports import orders_by_status
    o = seed["orders"]
    n = o.filter("order_status = 'Processing'").count()
    mixed = o.withColumn("order_status", F.upper("order_status"))
    assert orders_by_status(o.unionByName(mixed), "Processing").count() == 2 * n


def test_checkpoint_folder_is_registered_once(spark):
    from tavola.session import checkpoint_dir
    a = checkpoint_dir(spark)
    before = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert checkpoint_dir(spark) == a and spark.sparkContext._jsc.sc().getCheckpointDir().get() == before
