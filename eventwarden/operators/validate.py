"""Row rules of the business tables and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def length_between(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def user_rules() -> dict[str, Column]:
    return {
        "name length": length_between("name", 2, 100),
        "phone length": length_between("phone", 10, 15),
        "email form": F.col("email").rlike(EMAIL),
    }


def product_rules() -> dict[str, Column]:
    return {
        "name length": length_between("name", 1, 200),
        "price positive": F.col("price") > 0,
        "quantity not negative": F.col("quantity") >= 0,
    }


def order_rules() -> dict[str, Column]:
    return {
        "customer length": F.length("customer") >= 2,
        "product named": F.length("product") >= 1,
        "quantity at least one": F.col("quantity") >= 1,
    }


def payment_rules() -> dict[str, Column]:
    return {
        "customer length": F.length("customer") >= 2,
        "amount positive": F.col("amount") > 0,
    }


def notification_rules() -> dict[str, Column]:
    return {"user length": F.length("user") >= 2}


def label_rules() -> dict[str, Column]:
    return {"label is 0 or 1": F.col("label").isin(0, 1)}


# What a field shows when the stored document lacks it.
DEFAULTS = {
    "users": {"name": "", "email": "", "phone": "", "address": "", "role": "customer"},
    "orders": {"customer": "", "product": "", "quantity": 0, "status": "Pending"},
    "payments": {"customer": "", "amount": 0.0, "method": "", "status": "Success"},
    "notifications": {"user": "", "type": "", "message": "", "status": "Sent"},
}


def with_violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the broken rules. A null breaks its rule."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def valid_rows(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return with_violations(rows, rules).where(F.size("violations") == 0).drop("violations")


def invalid_rows(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return with_violations(rows, rules).where(F.size("violations") > 0)


def with_defaults(rows: DataFrame, kind: str) -> DataFrame:
    fills = {c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)
             for c, v in DEFAULTS[kind].items()}
    return rows.withColumns(fills)


def page(rows: DataFrame, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows in key order."""
    return rows.orderBy(key).offset(skip).limit(limit)
