"""Values of JSON fields without coercion: each check gives a value and an error, so a bad field rejects a row, not a batch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(field: Column) -> Column:
    return F.schema_of_variant(field)


def _absent(field: Column) -> Column:
    return field.isNull() | F.is_variant_null(field) | ((_kind(field) == "STRING") & (F.try_variant_get(field, "$", "string") == ""))


def _checked(field: Column, fine: Column, value: Column, name: str) -> Column:
    absent = _absent(field)
    bad = ~absent & ~F.coalesce(fine, F.lit(False))
    return F.struct(F.when(~absent & ~bad, value).alias("value"), F.when(bad, F.lit(f"invalid {name}")).alias("error"))


def nonnegative_int(field: Column, name: str) -> Column:
    """Null and "" are null; a boolean, fraction, string or negative number is an error."""
    value = F.try_variant_get(field, "$", "long")
    return _checked(field, (_kind(field) == "BIGINT") & (value >= 0), value, name)


def decimal(field: Column, name: str) -> Column:
    """A number or a numeric string of zero or more; null and "" are null, anything else is an error."""
    value = F.try_variant_get(field, "$", "decimal(38,9)")
    return _checked(field, (_kind(field) != "BOOLEAN") & value.isNotNull() & (value >= 0), value, name)


def yes_no(field: Column, name: str) -> Column:
    value = F.try_variant_get(field, "$", "string")
    return _checked(field, (_kind(field) == "STRING") & value.isin("Y", "N"), value == "Y", name)


def text(field: Column, name: str) -> Column:
    """A string that must be there."""
    value = F.try_variant_get(field, "$", "string")
    fine = ~_absent(field) & (_kind(field) == "STRING")
    return F.struct(F.when(fine, value).alias("value"), F.when(~fine, F.lit(f"missing {name}")).alias("error"))


def available(capacity: Column, reserved: Column) -> Column:
    """Struct (value, error): what is left, null if either is unknown; more reserved than there is is an error."""
    over = F.coalesce(reserved > capacity, F.lit(False))
    return F.struct(F.when(~over, capacity - reserved).alias("value"), F.when(over, "reserved exceeds capacity").alias("error"))
