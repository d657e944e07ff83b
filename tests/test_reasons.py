"""The registered batches meet every rule: each accepts some requests and gives every reason."""

import pytest

import __spark_entry__ as E
from conftest import SF01

SEQ = {"missing_request_seq", "repeated_request_seq"}
FIELDS = {"name_too_long", "email_too_long", "address_too_long"}
REASONS = {
    "account_delete_batch": SEQ | {"active_orders", "referenced", "not_found"},
    "customer_delete_batch": SEQ | {"has_orders", "referenced", "not_found"},
    "active_order_guard_batch": SEQ | {"active_orders", "referenced", "not_found"},
    "menu_delete_batch": SEQ | {"not_found", "ordered"},
    "delivery_status_batch": SEQ | {"not_found_or_unauthorized", "invalid_status"},
    "assignment_batch": SEQ | {"employee_not_found", "not_delivery_person", "no_courier_record", "courier_busy", "order_not_found"},
    "registration_batch": SEQ | FIELDS | {"missing_fields", "email_registered", "phone_registered", "invalid_phone", "invalid_email",
                                          "email_in_batch", "phone_in_batch"},
    # An e-mail too long for its column is never asked for here (unit tests do).
    "profile_update_batch": SEQ | FIELDS - {"email_too_long"} | {
        "missing_fields", "email_in_use", "email_in_batch", "phone_in_use", "phone_in_batch", "not_found", "invalid_phone", "invalid_email"},
    "feedback_batch": SEQ | {"missing_fields", "rating_out_of_range", "text_too_long", "order_not_found"},
    "menu_update_batch": SEQ | {"missing_name", "invalid_price", "invalid_category", "invalid_availability", "name_too_long",
                                "description_too_long", "not_found"},
    # Menu prices are never null here: invalid_total and priceless_item have unit tests.
    "place_orders_batch": SEQ | {"empty_cart", "unknown_item", "bad_quantity", "quantity_overflow", "customer_not_found",
                                 "invalid_payment_method"},
    "basket_lines_batch": SEQ | {"missing_item_id", "unknown_item", "empty_basket", "bad_quantity", "quantity_overflow"},
    "order_status_batch": SEQ | {"invalid_status", "order_not_found", "invalid_transition"},
    "order_status_strict_batch": SEQ | {"invalid_status", "order_not_found", "invalid_transition"},
    "employee_batch": SEQ | {"invalid_role", "missing_name", "name_too_long", "missing_phone", "invalid_salary", "not_found",
                             "duplicate_phone", "active_deliveries", "referenced", "invalid_op"},
}


@pytest.mark.parametrize("name", sorted(REASONS))
def test_every_reason_is_given(spark, name):
    counts = {r["reason"]: r["count"] for r in E.queries()[name](spark, SF01).groupBy("reason").count().collect()}
    assert counts.pop(None) > 0
    assert set(counts) == REASONS[name]
