"""Named data-quality rules. Like a database check, a rule that is null is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

#: Longest texts by column.
LENGTHS = {
    "title": 500, "organizer": 200, "venue": 300, "address": 500, "district": 50, "category": 100, "subcategory": 100, "original_category": 200,
    "registration_status": 50, "application_method": 100, "source_event_id": 255, "source_item_key": 255, "source_url": 2048, "reservation_url": 2048,
    "detail_url": 2048, "image_url": 2048, "source_code": 20,
}
BOUNDARIES = ("event_start", "event_end", "registration_start", "registration_end")


def event_rules() -> dict[str, Column]:
    rules = {f"{b}_precision": F.col(b).isNull() | F.col(f"{b}_date").isNull() for b in BOUNDARIES}
    for kind in ("event", "registration"):
        rules[f"{kind}_order"] = F.col(f"{kind}_end") >= F.col(f"{kind}_start")
        rules[f"{kind}_date_order"] = F.col(f"{kind}_end_date") >= F.col(f"{kind}_start_date")
    rules |= {f"{c}_length": F.char_length(c) <= n for c, n in LENGTHS.items() if c in schemas.EVENT_CONTENT or c == "source_item_key"}
    return rules | {f"{c}_present": F.col(c).isNotNull() for c in ("title", "source_item_key", "source_url")}


def occurrence_rules() -> dict[str, Column]:
    rules = {"time_present": F.col("start_at").isNotNull() & F.col("end_at").isNotNull(), "time_order": F.col("end_at") >= F.col("start_at")}
    rules |= {f"{c}_sign": F.col(c) >= 0 for c in ("capacity", "reserved_count", "available_count", "fee")}
    return rules | {"id_length": F.coalesce(F.char_length("source_occurrence_id").between(1, 512), F.lit(False))}


def run_rules() -> dict[str, Column]:
    counters = (
        "pages_attempted", "pages_succeeded", "items_seen", "items_persisted", "items_failed", "detail_success_count", "detail_failure_count",
        "occurrence_count", "network_error_count", "parser_error_count",
    )
    return {
        "status_domain": F.col("status").isin("running", "success", "partial", "failed"), "time_order": F.col("finished_at") >= F.col("started_at"),
        "pages_order": F.col("pages_succeeded") <= F.col("pages_attempted"),
    } | {f"{c}_sign": F.col(c) >= 0 for c in counters}


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in the rules' order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items())))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their violations."""
    checked = df.withColumn("violations", violations(rules))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once and how often; keys with a null are distinct from all others."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
