"""Small schemas: cycles, self-references, composite and polymorphic relationships, partitions."""

import datetime as dt

from rowcloak.model import ForeignKey, RelationalModel, TableSpec


def kitchen_sink(spark):
    companies = spark.createDataFrame([(i, 4 * i - 3, f"CanaryCorp {i}", f"corp-{i}") for i in (1, 2, 3)], "id long, owner_id long, name string, slug string")
    users = spark.createDataFrame(
        [(i, (i - 1) // 4 + 1, 1 if i > 1 else None, f"u{i}@real.example", None if i == 12 else f"Zcanaryfirst{i}", f"Zcanarylast{i}", None, "hunter2-canary") for i in range(1, 13)],
        "id long, company_id long, manager_id long, email string, first_name string, last_name string, full_name string, password string")
    users = users.selectExpr("id", "company_id", "manager_id", "email", "first_name", "last_name", "concat_ws(' ', first_name, last_name) as full_name", "password")
    items = spark.createDataFrame([(1, 1, "sku-a"), (1, 2, "sku-b")], "order_id long, line_no int, sku string")
    shipments = spark.createDataFrame([(1, 1, 2)], "id long, order_id long, line_no int")
    comments = spark.createDataFrame([(i, "User" if i < 12 else "Post", i, f"by u{i}@real.example") for i in range(1, 13)], "id long, commentable_type string, commentable_id long, body string")
    events = spark.createDataFrame([(i, i, dt.date(2026, 1, i)) for i in range(1, 13)], "id long, user_id long, created_at date")
    tables = [
        TableSpec("companies", companies, ("id",), (("slug",),), frozenset({"name", "slug"}), {"name": 120}, identity_always=frozenset({"id"}), sequences=("id",)),
        TableSpec("users", users, ("id",), (("email",),), frozenset({"company_id", "email"}), {"email": 255}, generated={"full_name": "concat_ws(' ', first_name, last_name)"}, sequences=("id",)),
        TableSpec("order_items", items, ("order_id", "line_no"), not_null=frozenset({"sku"})),
        TableSpec("shipments", shipments, ("id",)),
        TableSpec("comments", comments, ("id",), not_null=frozenset({"commentable_type", "commentable_id"})),
        TableSpec("events", events, ("id", "created_at")),
        TableSpec("events_2026", events, ("id", "created_at"), partition_of="events"),
    ]
    fks = [
        ForeignKey("companies", ("owner_id",), "users", ("id",), deferrable=True), ForeignKey("users", ("company_id",), "companies", ("id",)),
        ForeignKey("users", ("manager_id",), "users", ("id",)), ForeignKey("shipments", ("order_id", "line_no"), "order_items", ("order_id", "line_no")),
        ForeignKey("events", ("user_id",), "users", ("id",)), ForeignKey("events_2026", ("user_id",), "users", ("id",)),
        ForeignKey("comments", ("commentable_id",), "users", ("id",), when="commentable_type = 'User'", virtual=True),
    ]
    return RelationalModel(tables, fks)


RULES = {"companies.slug": "govid", "comments.body": "redact", "comments.commentable_type": "keep", "order_items.sku": "keep", "companies.name": "name"}
CANARIES = ["real.example", "Zcanaryfirst", "Zcanarylast", "hunter2-canary", "CanaryCorp"]
