"""Scalar business rules as Spark Column expressions.

They stay JVM-side (CASE / arithmetic / string built-ins), so Catalyst folds and
codegens them; ``register_sql_functions`` also exposes them to Spark SQL as
SQL-language functions, which the analyzer inlines the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"
MONEY_SUM = "decimal(18,2)"

__all__ = [
    "MONEY", "MONEY_SUM", "dec", "discount_pct", "service_rate", "service_charge",
    "format_vnd", "format_amount", "points_tier", "points_benefit", "membership_tier",
    "mask_phone", "invoice_amounts", "hour_label", "payment_label", "register_sql_functions",
]

# ---------------------------------------------------------------------------
# Fixed values (thresholds, rates and labels that results depend on)
# ---------------------------------------------------------------------------
# discount percent by loyalty points: >=1000 -> 10, >=500 -> 7, >=200 -> 5, else 0
DISCOUNT_STEPS = [(1000, "10.00"), (500, "7.00"), (200, "5.00")]
# service-charge rate by table location, default 0.05
SERVICE_RATES = {"VIP Room": "0.07", "Private Room": "0.07", "Banquet Hall": "0.08"}
DEFAULT_SERVICE_RATE = "0.05"
# UI tiers by points: (threshold, tier, benefit); below 200 -> Member / None
POINT_TIERS = [
    (1000, "Platinum", "15% off total bill"),
    (500, "Gold", "10% off total bill"),
    (200, "Silver", "5% off total bill"),
]
BASE_TIER, BASE_BENEFIT = "Member", "None"
# spend tiers of the customer-activity view
SPEND_TIERS = [(5000000, "Gold"), (2000000, "Silver")]
BASE_SPEND_TIER = "Bronze"
# payment-method labels
PAYMENT_LABELS = {"cash": "Cash", "card": "Card", "bank_transfer": "Transfer", "transfer": "Transfer", "ewallet": "E-Wallet"}


def dec(value: str) -> Column:
    """Exact decimal literal (never a binary double)."""
    digits = value.split(".")[1] if "." in value else ""
    return F.lit(value).cast(f"decimal({max(len(value.replace('.', '')), len(digits) + 1)},{len(digits)})")


def discount_pct(points: Column) -> Column:
    """Loyalty discount percent, DECIMAL(5,2); NULL points -> 0."""
    expr = None
    for threshold, pct in DISCOUNT_STEPS:
        cond = points >= threshold
        expr = F.when(cond, dec(pct)) if expr is None else expr.when(cond, dec(pct))
    return expr.otherwise(dec("0.00")).cast("decimal(5,2)")


def service_rate(location: Column) -> Column:
    expr = None
    for loc, rate in SERVICE_RATES.items():
        cond = location == loc
        expr = F.when(cond, dec(rate)) if expr is None else expr.when(cond, dec(rate))
    return expr.otherwise(dec(DEFAULT_SERVICE_RATE)).cast("decimal(4,2)")


def service_charge(location: Column, sub_total: Column) -> Column:
    """round(sub_total * rate(location), 2); unknown / NULL location -> 5 %."""
    return F.round(sub_total * service_rate(location), 2).cast(MONEY_SUM)


def format_amount(amount: Column) -> Column:
    """Thousands separators, no decimals, rounded half away from zero."""
    return F.format_number(F.round(amount, 0), 0)


def format_vnd(amount: Column) -> Column:
    return F.concat(format_amount(amount), F.lit(" VND"))


def points_tier(points: Column) -> Column:
    expr = None
    for threshold, tier, _ in POINT_TIERS:
        expr = F.when(points >= threshold, tier) if expr is None else expr.when(points >= threshold, tier)
    return expr.otherwise(BASE_TIER)


def points_benefit(points: Column) -> Column:
    expr = None
    for threshold, _, benefit in POINT_TIERS:
        expr = F.when(points >= threshold, benefit) if expr is None else expr.when(points >= threshold, benefit)
    return expr.otherwise(BASE_BENEFIT)


def membership_tier(total_spent: Column) -> Column:
    expr = None
    for threshold, tier in SPEND_TIERS:
        expr = F.when(total_spent >= threshold, tier) if expr is None else expr.when(total_spent >= threshold, tier)
    return expr.otherwise(BASE_SPEND_TIER)


def mask_phone(phone: Column) -> Column:
    return F.concat(F.lit("***-***-"), F.right(phone, F.lit(4)))


def invoice_amounts(sub_total: Column, discount_pct_col: Column) -> dict[str, Column]:
    """Invoice-procedure arithmetic, each step rounded to cents (half up)."""
    rate = discount_pct_col.cast("decimal(9,4)") * dec("0.01")
    disc = F.round(sub_total * rate, 2).cast(MONEY_SUM)
    svc = F.round((sub_total - disc) * dec("0.05"), 2).cast(MONEY_SUM)
    tax = F.round((sub_total - disc + svc) * dec("0.10"), 2).cast(MONEY_SUM)
    total = (sub_total - disc + svc + tax).cast(MONEY_SUM)
    return {"discount_amount": disc, "service_charge": svc, "tax_amount": tax, "total_amount": total}


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def payment_label(method: Column) -> Column:
    """Display label of a payment method; unknown -> Cash."""
    m = F.lower(method)
    expr = None
    for key, label in PAYMENT_LABELS.items():
        expr = F.when(m == key, label) if expr is None else expr.when(m == key, label)
    return expr.otherwise("Cash")


def register_sql_functions(spark: SparkSession) -> None:
    """Expose the rules to Spark SQL as SQL-language (inlined) functions."""
    steps = " ".join(f"WHEN points >= {t} THEN {p}" for t, p in DISCOUNT_STEPS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION discount_pct(points INT) RETURNS DECIMAL(5,2) "
        f"RETURN CASE {steps} ELSE 0.00 END"
    )
    rates = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SERVICE_RATES.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION service_charge(location STRING, sub_total DECIMAL(18,2)) "
        f"RETURNS DECIMAL(18,2) RETURN ROUND(sub_total * CASE location {rates} ELSE {DEFAULT_SERVICE_RATE} END, 2)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION format_vnd(amount DECIMAL(18,2)) RETURNS STRING "
        "RETURN concat(format_number(round(amount, 0), 0), ' VND')"
    )
    tiers = " ".join(f"WHEN points >= {t} THEN '{n}'" for t, n, _ in POINT_TIERS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION points_tier(points INT) RETURNS STRING "
        f"RETURN CASE {tiers} ELSE '{BASE_TIER}' END"
    )
