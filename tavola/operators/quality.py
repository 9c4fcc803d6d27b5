"""Constraint report: the schema's NOT NULL / CHECK / ENUM / length / UNIQUE / FOREIGN KEY rules as one query.

Parquet enforces none of them.  Every table is scanned once: a row gives one fact for each rule that it
breaks, one for each key that must be unique, one for each reference and, where others refer to the
table, one for its primary key.  A fact is two small numbers and a key: the space of the key (a table's primary
key and the references to it share one) and the slot of the rule there.  Facts are counted by (space, key), a
count for each slot, with partial sums before the only shuffle, so a key of very many rows is one row there
and a reference meets its primary key without a join.  From the counts come broken rows (their sum), repeated
keys (counts over one) and orphans (references without a primary key).  The result has a row for each rule (0 = clean).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.operators.staged import staged
from tavola.sources.domain import (
    INVOICE_STATUSES, ORDER_STATUSES, PAYMENT_METHODS, RESERVATION_STATUSES, STAFF_ROLES, TABLE_STATUSES, Domain,
)

ROW, UNIQUE, REFERENCE, PRIMARY = "broken", "repeated", "orphans", "pk"


@dataclass
class Rules:
    """The rules of one table.  ``rows``: (name, condition of a broken row); ``references``: (column, table)."""

    table: str
    rows: list[tuple[str, Column]]
    primary: str | None = None
    unique: list[str] = field(default_factory=list)
    references: list[tuple[str, str]] = field(default_factory=list)

    def names(self) -> list[tuple[str, str]]:
        return [(self.table, name) for name, _ in self.rows] + [(self.table, f"unique:{c}") for c in self.unique] + [(self.table, f"fk:{c}->{t}") for c, t in self.references]

    def facts(self, df: DataFrame, places: dict[tuple[str, str], tuple[int, int]]) -> DataFrame:
        """(space, slot, key) of every row, from one scan."""

        def fact(rule: str, key: Column) -> Column:
            space, slot = places[self.table, rule]
            return F.struct(F.lit(space).alias("space"), F.lit(slot).alias("slot"), key.cast("string").alias("key"))

        keys = [fact(f"unique:{c}", F.col(c)) for c in self.unique]
        keys += [fact(f"fk:{c}->{t}", F.col(c)) for c, t in self.references]
        keys += [fact(PRIMARY, F.col(self.primary))] if self.primary else []
        keys += [fact(name, F.when(bad, "")) for name, bad in self.rows]  # no key, no fact
        return df.select(F.inline(F.array(*keys))).where(F.col("key").isNotNull())


def fact_places(rules: list[Rules]) -> dict[tuple[str, str], tuple[int, int]]:
    """(table, rule) -> (space, slot).  A table's primary key (slot 0) and the references to it share a space; others have their own."""
    parents = {t: k for k, t in enumerate(dict.fromkeys([r.table for r in rules] + [t for r in rules for _, t in r.references]))}
    places, taken, spaces = {}, dict.fromkeys(parents, 0), len(parents)
    for r in rules:
        places[r.table, PRIMARY] = (parents[r.table], 0)
        for c, t in r.references:
            taken[t] += 1
            places[r.table, f"fk:{c}->{t}"] = (parents[t], taken[t])
        for name in [name for name, _ in r.rows] + [f"unique:{c}" for c in r.unique]:
            places[r.table, name] = (spaces, 0)
            spaces += 1
    return places


def _nn(col: str) -> tuple[str, Column]:
    return f"not_null:{col}", F.col(col).isNull()


def _ck(name: str, cond: Column) -> tuple[str, Column]:
    return f"check:{name}", ~cond  # NULL passes a CHECK, as in SQL


def _en(col: str, domain: list[str]) -> tuple[str, Column]:
    return f"enum:{col}", F.col(col).isNotNull() & ~F.lower(F.col(col)).isin(*domain)


def _len(col: str, most: int) -> tuple[str, Column]:
    return f"length:{col}", F.char_length(F.col(col)) > most


def schema_rules() -> list[Rules]:
    """All rules of the schema; fixed values: limits and lengths of its columns."""
    c = F.col
    return [
        Rules("categories", [_nn("category_name"), _len("category_name", 100)], "category_id", ["category_name"]),
        Rules("customers", [_nn("customer_name"), _nn("phone_number"), _ck("points_non_negative", c("loyalty_points") >= 0), _len("customer_name", 150),
                            _len("phone_number", 20), _len("email", 255)], "customer_id", ["phone_number", "email"]),
        Rules("staff", [_nn("staff_name"), _nn("role"), _en("role", STAFF_ROLES), _ck("salary_positive", c("salary") > 0), _len("staff_name", 150),
                        _len("phone_number", 20)], "staff_id", ["phone_number"]),
        Rules("tables", [_nn("table_number"), _nn("capacity"), _ck("capacity_1_20", c("capacity").between(1, 20)), _en("status", TABLE_STATUSES), _len("location", 100)],
              "table_id", ["table_number"]),
        Rules("menu_items", [_nn("category_id"), _nn("dish_name"), _nn("price"), _ck("price_positive", c("price") > 0), _len("dish_name", 200)], "dish_id", [],
              [("category_id", "categories")]),
        Rules("reservations", [_nn("customer_id"), _nn("table_id"), _nn("reserved_at"), _nn("guest_count"), _ck("guest_count_min_1", c("guest_count") >= 1),
                               _en("status", RESERVATION_STATUSES)], "reservation_id", [],
              [("customer_id", "customers"), ("table_id", "tables"), ("staff_id", "staff")]),
        Rules("orders", [_nn("table_id"), _en("status", ORDER_STATUSES)], "order_id", [],
              [("reservation_ref", "reservations"), ("table_id", "tables"), ("customer_id", "customers"), ("staff_id", "staff")]),
        Rules("order_details", [_nn("order_id"), _nn("dish_id"), _nn("quantity"), _nn("unit_price"), _ck("quantity_min_1", c("quantity") >= 1)], None, [],
              [("order_id", "orders"), ("dish_id", "menu_items")]),
        Rules("invoices", [_nn("order_id"), _nn("sub_total"), _nn("total_amount"), _en("payment_method", PAYMENT_METHODS), _en("status", INVOICE_STATUSES)], "invoice_id",
              ["order_id"], [("order_id", "orders"), ("customer_id", "customers")]),
        Rules("payments", [_nn("invoice_id"), _nn("amount"), _ck("amount_positive", c("amount") > 0), _en("method", PAYMENT_METHODS)], None, [],
              [("invoice_id", "invoices")]),
        Rules("table_status_log", [_nn("table_id"), _en("old_status", TABLE_STATUSES), _en("new_status", TABLE_STATUSES), _len("changed_by", 100)], None, [],
              [("table_id", "tables")]),
    ]


def schema_tables(d: Domain) -> dict[str, DataFrame]:
    """The tables that the rules are about; invoices are written once where payments are derived from them."""
    from tavola.operators.changes import status_log

    if "payments" not in d.__dict__:
        d = d.with_tables(invoices=staged(d.invoices, "invoices"))
    return {"categories": d.categories, "customers": d.customers, "staff": d.staff, "tables": d.dining_tables, "menu_items": d.menu_items,
            "reservations": d.reservations, "orders": d.dine_orders, "order_details": d.order_details, "invoices": d.invoices, "payments": d.payments,
            "table_status_log": status_log(d)}


def fact_counts(tables: dict[str, DataFrame], rules: list[Rules]) -> DataFrame:
    """(space, key, n0, n1, ...): the facts of all tables, counted by slot; one scan for each table, one shuffle."""
    places = fact_places(rules)
    facts = None
    for r in rules:
        own = r.facts(tables[r.table], places)
        facts = own if facts is None else facts.unionByName(own)
    slots = 1 + max(slot for _, slot in places.values())
    return facts.groupBy("space", "key").agg(*[F.count(F.when(F.col("slot") == k, 1)).alias(f"n{k}") for k in range(slots)])


def violations(counts: DataFrame, rules: list[Rules]) -> DataFrame:
    """(check_name, table_name, violations) of every rule."""
    slots = [c for c in counts.columns if c not in ("space", "key")][1:]
    found = counts.groupBy("space").agg(
        F.sum("n0").alias(ROW), F.sum(F.when(F.col("n0") > 1, F.col("n0"))).alias(UNIQUE),
        F.array(F.lit(0).cast("long"), *[F.sum(F.when(F.col("n0") == 0, F.col(n))) for n in slots]).alias(REFERENCE),  # by slot
    )
    places = fact_places(rules)
    kinds = {"unique": UNIQUE, "fk": REFERENCE}
    named = [(t, rule, kinds.get(rule.split(":")[0], ROW), *places[t, rule]) for r in rules for t, rule in r.names()]
    names = counts.sparkSession.createDataFrame(named, "table_name string, rule string, kind string, space int, slot int")
    n = F.when(F.col("kind") == ROW, F.col(ROW)).when(F.col("kind") == UNIQUE, F.col(UNIQUE)).otherwise(F.get(REFERENCE, F.col("slot")))
    return names.join(found, "space", "left").select(
        F.col("rule").alias("check_name"), "table_name", F.coalesce(n, F.lit(0).cast("long")).alias("violations")
    )


def constraint_report(d: Domain) -> DataFrame:
    rules = schema_rules()
    return violations(fact_counts(schema_tables(d), rules), rules)
