"""The domain adapter of ``tavola.sources.domain`` written as DuckDB CTEs.

Oracle SQL strings reference the domain names below; ``with_domain`` prepends
exactly the CTEs a query needs (transitively), in dependency order.  The raw
driver tables (``orders``, ``lineitem`` ...) are DuckDB views.
"""

from __future__ import annotations

import re

# Same lists as tavola.sources.domain, as SQL CASE branches.
_LOC = ("CASE s_nationkey % 5 WHEN 0 THEN 'Main Hall' WHEN 1 THEN 'VIP Room' WHEN 2 THEN 'Private Room' "
        "WHEN 3 THEN 'Banquet Hall' WHEN 4 THEN 'Outdoor' END")
_TSTAT = ("CASE s_suppkey % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'reserved' WHEN 2 THEN 'occupied' "
          "WHEN 3 THEN 'maintenance' END")
_ROLE = ("CASE n_nationkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' WHEN 2 THEN 'cashier' "
         "WHEN 3 THEN 'waiter' WHEN 4 THEN 'chef' END")
_RSTAT = ("CASE (event_id + user_id) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'cancelled' "
          "WHEN 3 THEN 'completed' END")


def _method(expr: str) -> str:
    return (f"CASE ({expr}) % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' WHEN 2 THEN 'bank_transfer' "
            "WHEN 3 THEN 'ewallet' END")


CTES: dict[str, str] = {
    "table_count": "SELECT count(*) AS n FROM supplier",
    "categories": """
        SELECT CAST(dense_rank() OVER (ORDER BY category_name) AS BIGINT) AS category_id, category_name,
               CAST(NULL AS VARCHAR) AS description
        FROM (SELECT DISTINCT p_type AS category_name FROM part) t""",
    "menu_items": """
        SELECT p_partkey AS dish_id, c.category_id, p_name AS dish_name, p_type AS category_name,
               CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS description,
               p_partkey % 10 <> 0 AS is_available,
               CAST(p_size AS INTEGER) AS preparation_time
        FROM part LEFT JOIN categories c ON c.category_name = part.p_type""",
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name,
               '09' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone_number,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'guest' || CAST(c_custkey AS VARCHAR) || '@mail.example' END AS email,
               'Street ' || CAST(c_nationkey AS VARCHAR) AS address,
               CASE WHEN c_custkey % 11 = 0 THEN NULL
                    ELSE CAST(DATE '2020-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS DATE) END AS join_date,
               CAST(greatest(0, floor(c_acctbal / 5)) AS INTEGER) AS loyalty_points,
               c_mktsegment <> 'AUTOMOBILE' AS is_active
        FROM customer""",
    "staff": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS staff_id, 'Staff ' || n_name AS staff_name, {_ROLE} AS role,
               CASE WHEN n_nationkey % 6 <> 0 THEN '08' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') END AS phone_number,
               CAST(n_regionkey * 250 + 900 AS DECIMAL(10,2)) AS salary
        FROM nation""",
    "dining_tables": f"""
        SELECT s_suppkey AS table_id, CAST(s_suppkey + 1 AS INTEGER) AS table_number,
               CAST(s_suppkey % 20 + 1 AS INTEGER) AS capacity, {_LOC} AS location, {_TSTAT} AS status
        FROM supplier""",
    "dine_orders": """
        SELECT o_orderkey AS order_id,
               o_orderkey % (SELECT n FROM table_count) AS table_id,
               CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_custkey END AS customer_id,
               o_orderkey % 25 AS staff_id,
               o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS order_time,
               CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open'
                    WHEN o_orderpriority = '5-LOW' THEN 'cancelled'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'served' ELSE 'preparing' END AS status,
               o_orderdate AS order_day,
               o_orderkey // 3 AS reservation_ref
        FROM orders""",
    "orders_with_reservation": """
        SELECT o.*, r.reservation_id
        FROM dine_orders o LEFT JOIN (SELECT reservation_id FROM reservations) r
          ON o.reservation_ref = r.reservation_id""",
    "order_details": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS dish_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)) AS unit_price,
               CAST(CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(10,0))
                    * CAST(CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2))
                    AS DECIMAL(18,2)) AS line_total,
               l_returnflag AS return_flag
        FROM lineitem""",
    "order_totals": """
        SELECT order_id, CAST(sum(line_total) AS DECIMAL(18,2)) AS sub_total, count(*) AS line_count
        FROM order_details GROUP BY order_id""",
    "invoice_base": """
        SELECT t.order_id, t.sub_total, o.o_custkey, o.o_orderstatus, o.o_orderdate,
               CAST(CAST(CAST(t.order_id % 4 * 5 AS DECIMAL(5,2)) AS DECIMAL(9,4)) * 0.01 AS DECIMAL(12,6)) AS rate
        FROM order_totals t JOIN orders o ON o.o_orderkey = t.order_id""",
    "invoice_disc": """
        SELECT *, CAST(round(sub_total * rate, 2) AS DECIMAL(18,2)) AS discount_amount FROM invoice_base""",
    "invoice_svc": """
        SELECT *, CAST(round((sub_total - discount_amount) * 0.05, 2) AS DECIMAL(18,2)) AS service_charge FROM invoice_disc""",
    "invoice_tax": """
        SELECT *, CAST(round((sub_total - discount_amount + service_charge) * 0.10, 2) AS DECIMAL(18,2)) AS tax_amount FROM invoice_svc""",
    "invoices": f"""
        SELECT order_id AS invoice_id, order_id,
               CASE WHEN order_id % 5 < 2 THEN NULL ELSE o_custkey END AS customer_id,
               sub_total, discount_amount, service_charge, tax_amount,
               CAST(sub_total - discount_amount + service_charge + tax_amount AS DECIMAL(18,2)) AS total_amount,
               {_method('order_id')} AS payment_method,
               CAST(o_orderdate AS DATE) AS payment_date,
               CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'unpaid' ELSE 'refunded' END AS status
        FROM invoice_tax""",
    "payments": f"""
        SELECT invoice_id * 2 AS payment_id, invoice_id, total_amount AS amount, payment_method AS method
        FROM invoices WHERE invoice_id % 3 <> 0
        UNION ALL
        SELECT invoice_id * 2, invoice_id,
               CAST(CAST(CAST(total_amount * 100 AS BIGINT) // 2 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)),
               payment_method
        FROM invoices WHERE invoice_id % 3 = 0
        UNION ALL
        SELECT invoice_id * 2 + 1, invoice_id,
               CAST(CAST(CAST(total_amount * 100 AS BIGINT) - CAST(total_amount * 100 AS BIGINT) // 2 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)),
               {_method('invoice_id + 1')}
        FROM invoices WHERE invoice_id % 3 = 0""",
    "reservations": f"""
        SELECT event_id AS reservation_id, user_id AS customer_id,
               (event_id * 31 + user_id) % (SELECT n FROM table_count) AS table_id,
               event_id % 30 AS staff_id,
               ts AS reserved_at,
               CAST(CAST(floor(value) AS INTEGER) % 8 + 1 AS INTEGER) AS guest_count,
               CASE WHEN event_type = 'purchase' THEN props END AS special_requests,
               {_RSTAT} AS status,
               ts - to_hours(CAST(event_id % 72 AS BIGINT)) AS created_at
        FROM events WHERE event_type IN ('signup', 'purchase')""",
    "table_events": """
        WITH oe AS (
          SELECT user_id AS order_key, user_id % (SELECT n FROM table_count) AS table_id, ts AS changed_at, event_id AS seq,
                 CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'preparing'
                                 WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'cancelled' END AS order_status,
                 'user' || CAST(user_id AS VARCHAR) AS changed_by
          FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error')),
        ol AS (SELECT *, lag(order_status) OVER (PARTITION BY order_key ORDER BY changed_at, seq) AS prev FROM oe),
        eff AS (SELECT table_id, changed_at, seq,
                       CASE WHEN order_status = 'open' AND prev IS NULL THEN 'occupied'
                            WHEN order_status IN ('closed', 'cancelled')
                                 AND prev IN ('open', 'preparing') THEN 'available' END AS new_status,
                       changed_by
                FROM ol)
        SELECT * FROM eff WHERE new_status IS NOT NULL
        UNION ALL
        SELECT user_id % (SELECT n FROM table_count), ts, event_id, 'reserved', 'user' || CAST(user_id AS VARCHAR)
        FROM events WHERE event_type = 'signup'""",
    # request batches of the set-based jobs
    "reservation_requests": """
        SELECT event_id AS request_id, user_id AS customer_id,
               (event_id * 7 + user_id) % (SELECT n FROM table_count) AS table_id,
               event_id % 25 AS staff_id, ts AS date_time,
               CAST(CAST(floor(value) AS INTEGER) % 10 + 1 AS INTEGER) AS guest_count
        FROM events WHERE event_type = 'view'""",
    "invoice_requests": f"""
        SELECT o.order_id * 2 + again AS request_id, o.order_id, {_method('o.order_id + 2')} AS payment_method,
               CAST(CASE WHEN c.loyalty_points IS NULL THEN 0 WHEN c.loyalty_points >= 1000 THEN 10
                         WHEN c.loyalty_points >= 500 THEN 7 WHEN c.loyalty_points >= 200 THEN 5 ELSE 0 END AS DECIMAL(5,2)) AS discount_pct
        FROM (SELECT *, unnest(CASE WHEN order_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS again FROM dine_orders) o
        LEFT JOIN customers c ON o.customer_id = c.customer_id""",
    "order_requests": """
        SELECT event_id AS request_id, user_id % (SELECT n FROM table_count) AS table_id,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS customer_id,
               event_id % 25 AS staff_id,
               CAST(CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS item_count
        FROM events WHERE event_type = 'click'""",
    "menu_upserts": """
        SELECT p_partkey AS request_id, p_partkey AS dish_id,
               CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_brand END AS category
        FROM part""",
    "menu_writes": """
        SELECT p_partkey AS request_id,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 22 = 1 THEN (SELECT max(p_partkey) FROM part) + 1 + p_partkey % 50
                    ELSE (p_partkey * 7) % (SELECT count(*) FROM part) END AS dish_id,
               CASE WHEN p_partkey % 11 = 0 OR p_partkey % 4 = 0 THEN 'Special ' || p_name END AS name,
               CASE WHEN p_partkey % 11 = 0 OR p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE 'Chef ' || p_brand END END AS category,
               CASE WHEN p_partkey % 11 = 0 OR p_partkey % 5 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) + 1.50 AS DECIMAL(10,2)) END AS price,
               CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN p_partkey % 14 <> 0 END AS is_available,
               CASE WHEN (p_partkey % 11 = 0 AND p_partkey % 2 = 0) OR p_partkey % 6 = 0 THEN p_brand END AS description,
               CASE WHEN p_partkey % 11 = 0 OR p_partkey % 8 = 0 THEN CAST(p_size + 1 AS INTEGER) END AS prep_time
        FROM part""",
    "customer_updates": """
        SELECT event_id AS request_id, user_id AS customer_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS phone,
               CASE WHEN event_id % 3 = 0 THEN 'new' || CAST(event_id AS VARCHAR) || '@mail.example' END AS email,
               CAST(NULL AS VARCHAR) AS address,
               CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS INTEGER) END AS points,
               CASE WHEN event_id % 5 = 0 THEN false END AS is_active
        FROM events WHERE event_type = 'signup'""",
    "customer_inserts": """
        SELECT event_id AS request_id, 'Guest ' || CAST(event_id AS VARCHAR) AS name,
               '09' || lpad(CAST(event_id % ((SELECT count(*) FROM customer) * 2) AS VARCHAR), 8, '0') AS phone,
               CASE WHEN event_id % 4 = 0 THEN NULL
                    ELSE 'guest' || CAST(event_id % ((SELECT count(*) FROM customer) * 3) AS VARCHAR) || '@mail.example' END AS email
        FROM events WHERE event_type = 'error'""",
}


def _deps(sql: str) -> list[str]:
    return [name for name in CTES if re.search(rf"\b{name}\b", sql)]


def with_domain(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the domain CTEs it references (and their dependencies)."""
    ctes = dict(CTES)
    if extra:
        ctes.update(extra)
    order: list[str] = []

    def visit(name: str, seen: set[str]) -> None:
        if name in order or name in seen:
            return
        seen.add(name)
        body = ctes[name]
        for dep in [n for n in ctes if n != name and re.search(rf"\b{n}\b", body)]:
            visit(dep, seen)
        order.append(name)

    for name in [n for n in ctes if re.search(rf"\b{n}\b", sql)]:
        visit(name, set())
    sql = sql.strip()
    if not order:
        return sql
    body = ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in order)
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {body},\n{sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"

CTES.update({
    "menu_quick_updates": """
        SELECT p_partkey AS request_id, p_partkey AS dish_id,
               CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS is_available,
               CASE WHEN p_partkey % 5 = 0 THEN CAST(round(CAST(p_retailprice AS DECIMAL(10,2)) * 1.1, 2) AS DECIMAL(10,2)) END AS price
        FROM part""",
    "table_updates": """
        SELECT s_suppkey AS request_id, s_suppkey AS table_id,
               CASE WHEN s_suppkey % 3 = 0 THEN 'available' END AS status,
               CASE WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey % 12 + 2 AS INTEGER) END AS capacity,
               CASE WHEN s_suppkey % 3 = 2 THEN 'Terrace' END AS location
        FROM supplier""",
})
