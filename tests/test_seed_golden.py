"""Golden values on the shipped seed rows (worked out from the trigger rules)."""

from decimal import Decimal

from conftest import rows
from tavola.operators import reports as R


def test_order_totals(seed):
    got = dict(rows(seed["orders"], "order_id", "total_price"))
    assert got == {"O001": Decimal("398.00"), "O002": Decimal("200.00"), "O003": Decimal("297.00"),
                   "O004": Decimal("250.00"), "O005": Decimal("80.00"), "O006": Decimal("100.00"),
                   "O007": Decimal("90.00")}


def test_payment_amount_follows_total(seed):
    got = dict(rows(seed["payment"], "order_id", "amount"))
    assert got["O001"] == Decimal("398.00") and got["O007"] == Decimal("90.00")


def test_sales_summary(seed):
    r = R.sales_summary(seed).first()
    assert r.total_sales == Decimal("1415.00")
    assert abs(r.avg_order_value - 202.142857) < 1e-5
    assert r.total_orders == 7


def test_sales_by_status(seed):
    assert rows(R.sales_by_status(seed)) == [("Cancelled", 1, Decimal("80.00")), ("Completed", 3, Decimal("795.00")),
                                             ("Processing", 3, Decimal("540.00"))]


def test_sales_by_status_sums_to_summary(seed):
    total = sum(r.total for r in R.sales_by_status(seed).collect())
    assert total == R.sales_summary(seed).first().total_sales


def test_top_items(seed):
    got = [(r.item_name, r.total_revenue, r.total_quantity) for r in R.top_items(seed).collect()]
    assert got == [("Veggie Delight Pizza", Decimal("398.00"), 2), ("Classic Cold Coffee", Decimal("297.00"), 3),
                   ("Alfredo Pasta", Decimal("250.00"), 1), ("Tiramisu", Decimal("200.00"), 1),
                   ("Spicy Chicken Wings", Decimal("100.00"), 1)]


def test_category_distribution(seed):
    assert rows(R.category_distribution(seed)) == [
        ("Desserts", 2, Decimal("279.00")), ("Drinks", 2, Decimal("139.00")), ("Non-Veg Starter", 1, Decimal("100.00")),
        ("Veg Main Course", 3, Decimal("599.00")), ("Veg Starter", 1, Decimal("90.00"))]


def test_customer_stats_skips_customers_without_orders(seed):
    r = R.customer_stats(seed).first()
    assert (r.total_customers, r.avg_orders_per_customer, r.max_orders) == (10, 1.0, 1)


def test_menu_search(seed):
    got = sorted(r.name for r in R.menu_search(seed, "veg").collect())
    assert got == ["Alfredo Pasta", "Cheese Hamburger", "Paneer Tikka", "Spicy Chicken Wings", "Veggie Delight Pizza"]


def test_available_couriers_asis_and_intended(seed):
    assert [r.employee_id for r in R.available_couriers_asis(seed).orderBy("employee_id").collect()] == \
        ["E004", "E005", "E009", "E010"]
    assert [r.employee_id for r in R.available_couriers(seed).orderBy("employee_id").collect()] == \
        ["E004", "E005", "E009"]


def test_not_in_with_null_courier_is_empty(spark, seed):
    from pyspark.sql import functions as F
    t = dict(seed)
    extra = spark.createDataFrame([("D005", "O002", None, "Out for Delivery", None)], t["deliveries"].schema)
    t["deliveries"] = t["deliveries"].unionByName(extra)
    assert R.available_couriers_asis(t).count() == 0
    assert R.available_couriers(t).count() == 3
    assert t["deliveries"].filter(F.col("delivery_person_id").isNull()).count() == 1


def test_unassigned_and_active(seed):
    assert R.unassigned_orders(seed).count() == 0
    act = R.active_deliveries(seed).collect()
    assert len(act) == 1 and act[0].delivery_id == "D004" and act[0].order_id == "O007" and act[0].delivery_time is None


def test_customers_with_order_count_zero(seed):
    got = dict(rows(R.customers_with_order_count(seed), "customer_id", "order_count"))
    assert got["C010"] == 0 and got["C001"] == 1


def test_row_numbers_follow_name_order(seed):
    got = [(r.row_no, r.name) for r in R.numbered_customers(seed).orderBy("row_no").collect()]
    names = sorted(r.name for r in seed["customer"].collect())
    assert [n for _, n in got] == names and [i for i, _ in got] == list(range(1, 11))


def test_order_labels(seed):
    lab = {r.order_id: r for r in R.order_labels(seed).collect()}
    assert lab["O001"].items_label == "Veggie Delight Pizza (2)"
    assert lab["O001"].status_class == "completed" and lab["O001"].total_text == "398.00"
    assert lab["O001"].day_text == "25/3/2024"


def test_feedback_list_stars(seed):
    got = {r.rating_id: r.full_stars for r in R.feedback_list(seed).collect()}
    assert got == {"F001": 5, "F002": 5, "F003": 5}
    assert [r.rating_id for r in R.feedback_list(seed).collect()] == ["F003", "F002", "F001"]


def test_max_keys(seed):
    got = dict(rows(R.max_keys(seed)))
    assert got["customer"] == 10 and got["orders"] == 7 and got["feedback"] == 3


def test_pending_ratings_empty_on_seed(seed):
    assert R.pending_ratings(seed).count() == 0


def test_courier_mean_rating(seed):
    got = {r.delivery_person_id: r.mean_rating for r in R.courier_mean_rating(seed).collect()}
    assert got == {"D001": 4.8, "D002": 4.5, "D003": 4.7}


def test_nested_replies(spark, seed):
    import datetime as dt
    t = dict(seed)
    t["orders"] = t["orders"].unionByName(spark.createDataFrame(
        [("O008", "C008", "I404", None, "Pending", dt.datetime(2024, 4, 1))], t["orders"].schema))
    t["payment"] = t["payment"].unionByName(spark.createDataFrame(
        [("P000", "O001", Decimal("1.00"), "Failed", "UPI", dt.datetime(2024, 3, 25))], t["payment"].schema))
    t["items"] = t["items"].unionByName(spark.createDataFrame(
        [("I001", "M009", 1, Decimal("79.00"))], t["items"].schema))
    allo = {r.order_id: r for r in R.all_orders_nested(t).collect()}
    assert allo["O008"].items == [] and allo["O008"].customer_name == "Tanvi Bhat"
    assert [x.menu_id for x in allo["O001"].items] == ["M001", "M009"]  # J2 lines sorted by menu id
    cust = {r.order_id: r for r in R.customer_orders_nested(t).collect()}
    assert cust["O001"].payment_method == "UPI" and cust["O001"].payment_status == "Failed"  # lowest payment id
    assert len(cust["O001"].items) == 2 and "O008" not in cust
    det = {r.order_id: r for r in R.order_details_nested(t).collect()}
    assert [x.price for x in det["O001"].items] == [Decimal("79.00"), Decimal("199.00")]  # current menu price
