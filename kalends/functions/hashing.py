"""Digests of a row's content that don't depend on when it was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def stable(value: Column, kind: T.DataType) -> Column:
    """Instants as UTC ISO text, dates as ISO text, decimals plain without trailing zeros, others as they are."""
    if isinstance(kind, T.TimestampType):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, T.DecimalType):
        text = value.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if isinstance(kind, T.StructType):
        return F.struct(*(stable(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: stable(x, kind.elementType))
    return value


def content_hash(df: DataFrame, fields: list[str]) -> Column:
    """SHA-256 of compact JSON of the fields in name order, nulls included."""
    kinds = {f.name: f.dataType for f in df.schema}
    row = F.struct(*(stable(F.col(c), kinds[c]).alias(c) for c in sorted(fields)))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def _json(df: DataFrame, fields: list[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema}
    return F.to_json(F.struct(*(stable(F.col(c), kinds[c]).alias(c) for c in fields)), {"ignoreNullFields": "false"})


def event_hash(events: DataFrame, occurrences: DataFrame, key: str = "source_item_key") -> DataFrame:
    """events with content_hash over all schemas.HASHED columns and their occurrences, sorted by id in code point order.

    Only an event's own occurrences are gathered, each as its JSON text. When rows were read, and the raw payload, don't count.
    """
    one = F.struct(F.col("source_occurrence_id").alias("id"), _json(occurrences, sorted(schemas.OCCURRENCE_HASHED)).alias("json"))
    lists = occurrences.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_list"))
    joined = events.join(lists, key, "left")
    inside = F.coalesce(F.array_join(F.transform("_list", lambda x: x["json"]), ","), F.lit(""))
    head, tail = (_json(joined, [c for c in schemas.HASHED if (c < "occurrences") == first]) for first in (True, False))
    whole = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"occurrences":['), inside, F.lit("],"), F.substring(tail, 2, 1 << 30))
    return joined.withColumn("content_hash", F.sha2(whole, 256)).drop("_list")
