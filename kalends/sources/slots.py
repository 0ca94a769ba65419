"""Time slots from JSON payloads, without coercion, by Spark's variant functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import period, strict

#: Field names of the two payload kinds: (capacity, reserved).
FIELDS = {"EXP": ("useLmtNmpr", "rsvCnt"), "DAY": ("lmtNmpr", "curNope")}


def rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Explodes the array in payload into pos and row (a variant), keeping the other columns.

    A byte-order mark is ignored. A payload that is no JSON array of objects gives one row with pos null and an error.
    """
    keep = [c for c in payloads.columns if c != payload]
    parsed = payloads.withColumn("_v", F.try_parse_json(F.regexp_replace(F.col(payload), "^﻿", "")))
    kind = F.schema_of_variant("_v")
    parsed = parsed.withColumn("_list", F.coalesce(kind.startswith("ARRAY"), F.lit(False)))
    bad = parsed.where("NOT _list").select(*keep, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("row"), F.lit("payload is not a JSON array").alias("error"))
    slots = payloads.sparkSession.tvf.variant_explode(F.col("_v").outer())
    good = parsed.where("_list").lateralJoin(slots).select(*keep, "pos", F.col("value").alias("row"))
    good = good.withColumn("error", F.when(~F.schema_of_variant("row").startswith("OBJECT"), F.lit("slot is not an object")))
    return good.unionByName(bad)


def _field(name: str) -> Column:
    return F.try_variant_get("row", f"$.{name}", "variant")


def occurrences(payloads: DataFrame, kind: str) -> DataFrame:
    """Occurrences of payloads(resource_id, day, payload): one row per slot with an error where a field is bad.

    Ids are "resource:day:slot id" for EXP and "resource:day:start:end" for DAY. The raw slot stays as JSON text.
    """
    capacity_name, reserved_name = FIELDS[kind]
    r = rows(payloads)
    r = r.withColumn("_start", strict.text(_field("stTm"), "stTm")).withColumn("_end", strict.text(_field("enTm"), "enTm"))
    r = r.withColumn("_capacity", strict.nonnegative_int(_field(capacity_name), capacity_name)).withColumn("_reserved", strict.nonnegative_int(_field(reserved_name), reserved_name))
    r = r.withColumn("_fee", strict.decimal(_field("fee"), "fee")).withColumn("_open", strict.yes_no(_field("aplyYn"), "aplyYn"))
    r = r.withColumn("_id", strict.nonnegative_int(_field("oprtId"), "oprtId"))
    day = F.date_format("day", "yyyy-MM-dd")
    r = r.withColumn("start_at", period.instant(F.concat(day, F.lit(" "), F.col("_start.value")))).withColumn("end_at", period.instant(F.concat(day, F.lit(" "), F.col("_end.value"))))
    r = r.withColumn("_left", strict.available(F.col("_capacity.value"), F.col("_reserved.value")))
    slot = F.col("_id.value").cast("string") if kind == "EXP" else F.concat_ws(":", "_start.value", "_end.value")
    errors = ["error", "_start.error", "_end.error", "_capacity.error", "_reserved.error", "_fee.error", "_open.error", "_left.error"]
    late = F.when(F.col("start_at").isNull() | F.col("end_at").isNull(), "invalid time").when(F.col("end_at") < F.col("start_at"), "slot ends before it starts")
    missing = [F.coalesce(F.col("_id.error"), F.when(F.col("_id.value").isNull(), "missing oprtId"))] if kind == "EXP" else []
    return r.select(
        "resource_id", "day", "pos", F.concat_ws(":", "resource_id", day, slot).alias("source_occurrence_id"), "start_at", "end_at",
        F.col("_capacity.value").alias("capacity"), F.col("_reserved.value").alias("reserved_count"), F.col("_left.value").alias("available_count"),
        F.col("_fee.value").alias("fee"), (F.col("_fee.value") == 0).alias("is_free"), F.col("_open.value").alias("application_available"),
        F.to_json("row").alias("source_raw_data"), F.coalesce(*map(F.col, errors), *missing, late).alias("error"),
    )
