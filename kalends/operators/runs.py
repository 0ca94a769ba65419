"""The ledger of collection runs: verdicts, status of sources and the gate before anything unseen is deactivated."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import in_order, staged

MESSAGE_LIMIT = 10_000
#: Scope of a run to the source codes it covers.
SCOPES = {"F300": ("F300",), "F400": ("F400",), "F300:F400": ("F300", "F400"), "full": ("F300", "F400")}


def joined_errors(order: str, message: str, limit: int = MESSAGE_LIMIT) -> Column:
    """Aggregate: messages in order, joined by " | " and cut to the limit; null if there is none."""
    rows = F.array_sort(F.collect_list(F.when(F.col(message).isNotNull(), F.struct(order, message))))
    return F.nullif(F.substring(F.array_join(F.transform(rows, lambda x: x[message]), " | "), 1, limit), F.lit(""))


def first_messages(df: DataFrame, key: list[str], order: str, message: str, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """key and message: joined_errors() of each key, gathering no more messages than the limit can show."""
    some = df.where(F.col(message) != "").select(*key, order, message)
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order, message))
    return some.withColumn("_n", n).where(F.col("_n") <= limit // 4 + 1).groupBy(*key).agg(joined_errors(order, message, limit).alias("message"))


def followed(pages: DataFrame, key: list[str], page_size: int) -> DataFrame:
    """Landed pages with what following the links from page 1 tells of each: `follows` and `step`.

    pages: key, page, list_count, succeeded, next_page, pagination_detected, detail_failures, error_count, and `attempt` if a page may
    have landed more than once (the last one counts; without it the greatest row does). A page whose next page is
    further on than the following one did not succeed. follows: the page that a reader asks for after this one, null where it stops (a failure, a short page, no
    pagination, no next page). step: how many pages come before it from page 1 on, null if none leads there.

    Pointers double: in round k each page knows the page 2^k further on, and what is reached within 2^k pages gives what is reached
    within twice as many. One self-join and one aggregate a round, all runs at once; the key holds the page, so a run of very
    many pages is spread like many runs.
    """
    others = [c for c in pages.columns if c not in (*key, "page")]
    newest = F.max_by(F.struct(*others), "attempt") if "attempt" in others else F.max(F.struct(*others))
    once = pages.groupBy(*key, "page").agg(newest.alias("_p")).select(*key, "page", *(F.col("_p")[c].alias(c) for c in others))
    skips = F.coalesce(F.col("next_page") > F.col("page") + 1, F.lit(False))
    once = once.withColumns({
        "succeeded": F.coalesce(F.col("succeeded"), F.lit(False)) & ~skips, "error_count": F.col("error_count") + skips.cast("int"), "skips": skips, "pagination_detected": F.coalesce("pagination_detected", F.lit(False)),
    })
    goes_on = F.col("succeeded") & (F.col("list_count") >= page_size) & F.col("pagination_detected")
    once = staged(once.withColumn("follows", F.when(goes_on, F.col("next_page"))))
    state = once.select(*key, "page", F.col("follows").alias("to"), F.when(F.col("page") == 1, F.lit(0)).cast("long").alias("step"))
    reached, k = -1, 0
    while True:
        state = staged(state)
        now = state.where("step IS NOT NULL").count()
        if now == reached:
            break
        reached = now
        ahead = state.select(*key, F.col("page").alias("to"), F.col("to").alias("_far"), F.lit(True).alias("_landed"))
        pairs = state.join(ahead, [*key, "to"], "left")
        own = F.struct(F.col("page").alias("page"), F.col("_far").alias("to"), F.col("step").alias("step"))
        onward = F.struct(F.col("to").alias("page"), F.lit(None).cast(state.schema["to"].dataType).alias("to"), (F.col("step") + (1 << k)).alias("step"))
        both = F.when(F.col("_landed") & F.col("step").isNotNull(), F.array(own, onward)).otherwise(F.array(own))
        state = pairs.select(*key, F.explode(both).alias("_s")).groupBy(*key, F.col("_s.page").alias("page")).agg(F.max("_s.to").alias("to"), F.min("_s.step").alias("step"))
        k += 1
    return once.join(state.select(*key, "page", "step"), [*key, "page"])


def chains(pages: DataFrame, key: list[str], page_size: int, max_pages: int) -> DataFrame:
    """One row per run with what the verdict needs, from a row per landed page (see followed()).

    last: the last page that a reader of at most max_pages pages comes to, null if page 1 is missing; pages_followed: how many it
    reads; missing_page: the one it asks for that never landed; loops: whether it comes back to a page it has read;
    pages_unreached and pages_skipping: landed pages that no chain leads to, and those that link beyond the next. All aggregates
    combine before the shuffle.
    """
    read = F.coalesce(F.col("step") < max_pages, F.lit(False))
    row = F.struct("page", "list_count", "succeeded", "next_page", "pagination_detected", "follows", "step")
    per_run = followed(pages, key, page_size).groupBy(*key).agg(
        F.max_by(row, F.when(read, F.col("step"))).alias("last"), F.count(F.lit(1)).alias("pages_attempted"), F.count_if("succeeded").alias("pages_succeeded"), F.count_if(read).alias("pages_followed"),
        F.count_if(~read).alias("pages_unreached"), F.count_if("skips").alias("pages_skipping"), F.sum("list_count").alias("items_seen"), F.sum("detail_failures").alias("detail_failure_count"),
        F.sum("error_count").alias("error_count"), F.max("step").alias("_steps"),
    )
    last = F.col("last")
    full = F.coalesce(last["step"] + 1 >= max_pages, F.lit(False))
    # A reader that asks for a page behind the last one it comes to, and may still read one, lacks it or has read it before.
    asks = F.when(~full, last["follows"])
    return per_run.withColumns({
        "missing_page": F.when(last.isNull(), F.lit(1)).when(asks > last["page"], asks), "loops": F.coalesce(asks <= last["page"], F.lit(False)), "full": full,
    }).drop("_steps")


def stop_reason(page_size: int) -> Column:
    """Why a traversal ended, over chains()'s columns; the first that holds."""
    last = F.col("last")
    short, more = last["list_count"] < page_size, last["next_page"].isNotNull()
    return (
        F.when(last.isNull() | F.col("missing_page").isNotNull(), "page-missing").when(F.col("loops"), "page-loop")
        .when(short & more & last["succeeded"], "pagination-conflict")
        .when(last["succeeded"] & (last["list_count"] == page_size) & ~last["pagination_detected"], "pagination-missing")
        .when(F.col("full") & more, "max-pages").when(~last["succeeded"], "page-failure").when(short, "short-page").otherwise("last-page")
    )


def repeated_keys(events: DataFrame, key: list[str], item: str = "source_item_key") -> DataFrame:
    """key and repeated_keys: how many item keys a run holds more than once, on one page or on several. Runs without are left out."""
    twice = events.where(F.col(item).isNotNull()).groupBy(*key, item).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.groupBy(*key).agg(F.count(F.lit(1)).alias("repeated_keys"))


def with_issues(pages: DataFrame, issues: DataFrame, key: list[str]) -> DataFrame:
    """pages with detail_failures, error_count and succeeded after issues(key, page, phase, ...), as normalize.issues() gives.

    Every issue is an error; one of phase `detail` is a failed detail too, and one of phase `list` makes its page fail.
    """
    given = issues.groupBy(*key, "page").agg(
        F.count_if(F.col("phase") == "detail").cast("int").alias("_details"), F.count(F.lit(1)).cast("int").alias("_errors"), F.count_if(F.col("phase") == "list").alias("_listed")
    )
    joined = pages.join(given, [*key, "page"], "left")
    return joined.withColumns({
        "detail_failures": F.col("detail_failures") + F.coalesce("_details", F.lit(0)), "error_count": F.col("error_count") + F.coalesce("_errors", F.lit(0)),
        "succeeded": F.col("succeeded") & (F.coalesce("_listed", F.lit(0)) == 0),
    }).drop("_details", "_errors", "_listed")


def verdict(runs: DataFrame, page_size: int, repeated: DataFrame | None = None) -> DataFrame:
    """Adds stop_reason, is_complete_snapshot and status to chains()'s rows.

    A run is a complete snapshot if the chain from page 1 ends by itself and holds every landed page, every page succeeded, no
    error of any kind was counted, and no item key repeats (repeated: repeated_keys() of the run's events).
    """
    if repeated is None:
        runs = runs.withColumn("repeated_keys", F.lit(0).cast("long"))
    else:
        keys = [c for c in repeated.columns if c != "repeated_keys"]
        runs = runs.join(repeated, keys, "left").withColumn("repeated_keys", F.coalesce("repeated_keys", F.lit(0).cast("long")))
    none = [F.col(c) == 0 for c in ("pages_unreached", "pages_skipping", "repeated_keys", "error_count", "detail_failure_count")]
    natural = F.col("stop_reason").isin("short-page", "last-page") & F.col("last.succeeded") & F.col("last.next_page").isNull()
    complete = F.coalesce(reduce(and_, none, natural & (F.col("pages_succeeded") == F.col("pages_attempted"))), F.lit(False))
    return (
        runs.withColumn("stop_reason", stop_reason(page_size)).withColumn("is_complete_snapshot", complete)
        .withColumn("status", F.when(F.col("is_complete_snapshot"), "success").when(F.col("pages_succeeded") > 0, "partial").otherwise("failed"))
    )


def page_run_status(errors: Column, upserts: Column) -> Column:
    return F.when(errors == 0, "success").when(upserts > 0, "partial").otherwise("failed")


def full_run_status(collection: Column, persist_errors: Column, pages_succeeded: Column, upserts: Column) -> Column:
    return F.when((collection == "success") & (persist_errors == 0), "success").when((pages_succeeded > 0) | (upserts > 0), "partial").otherwise("failed")


def finished(runs: DataFrame, outcome: DataFrame) -> DataFrame:
    """Runs with their outcome(id, ...) filled in. Only a running run may be finished; any other id raises."""
    wrong = outcome.join(runs.where("status = 'running'").select("id"), "id", "left_anti").take(1)
    if wrong:
        raise ValueError(f"run {wrong[0]['id']} is not running")
    new = outcome.select("id", F.struct(*(c for c in outcome.columns if c != "id")).alias("_new"))
    names = [c for c in outcome.columns if c != "id"]
    out = runs.join(new, "id", "left")

    def value(c: str) -> Column:
        if c not in names:
            return F.col(c)
        got = F.nullif(F.substring(F.col("_new")[c], 1, MESSAGE_LIMIT), F.lit("")) if c == "error_message" else F.col("_new")[c]
        return F.when(F.col("_new").isNotNull(), got).otherwise(F.col(c)).alias(c)

    return out.select(*map(value, runs.columns))


def failure_streaks(runs: DataFrame, key: str, order: list[str], failed: Column, per_slice: int = 200_000) -> DataFrame:
    """Adds error_count: failures in a row up to each run; a success sets it to zero.

    A segmented scan: runs are cut into slices in order of key and time, each counts by itself and says how many failures it ends
    with and whether it is nothing else; slices of a key then combine in order, and a slice's runs before its first success add what
    comes in from before. So no key's runs are ordered in one place, however many it has.
    """
    slices = in_order(runs.withColumn("_bad", F.coalesce(failed, F.lit(False))), [key, *order], per_slice)
    bad = F.col("_bad").cast("long")
    own = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = slices.withColumn("_island", F.sum(1 - bad).over(own))
    island = Window.partitionBy(key, "_slice", "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = islands.withColumn("_inside", F.sum(bad).over(island))
    ends = slices.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.sum(bad).alias("_failed"), F.max(F.when(~F.col("_bad"), F.struct(*order))).alias("_success"))
    after = slices.join(ends.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), "_success"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")))
    tails = after.where("_bad AND _success IS NOT NULL").where(F.struct(*order) > F.col("_success")).groupBy("_k", "_s").agg(F.count(F.lit(1)).alias("_tail"))
    whole = ends.join(tails, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")), "left").drop("_k", "_s")
    whole = whole.withColumns({"_all": F.col("_success").isNull(), "_tail": F.when(F.col("_success").isNull(), F.col("_failed")).otherwise(F.coalesce("_tail", F.lit(0)))})
    along = Window.partitionBy(key).orderBy("_slice")
    whole = whole.withColumn("_group", F.sum((~F.col("_all")).cast("long")).over(along))
    whole = whole.withColumn("_upto", F.sum("_tail").over(Window.partitionBy(key, "_group").orderBy("_slice")))
    carry = whole.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), F.coalesce(F.lag("_upto").over(along), F.lit(0)).alias("_carry"))
    out = inside.join(carry, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")))
    return out.select(*runs.columns, (F.col("_inside") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)).alias("error_count"))


def scope_codes(scope: Column) -> Column:
    """The source codes that a scope covers; none for a scope that isn't known."""
    known = F.create_map(*(x for k, v in SCOPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(known, scope), F.array().cast("array<string>"))


def may_deactivate() -> Column:
    """Whether a run proves that what it did not see is gone."""
    return F.coalesce((F.col("status") == "success") & F.col("is_complete_snapshot") & F.col("finished_at").isNotNull() & (F.size(scope_codes(F.col("scope"))) > 0), F.lit(False))


def unseen(run_id: int, codes: list[str]) -> Column:
    return F.col("source_code").isin(*codes) & ~F.col("last_seen_run_id").eqNullSafe(F.lit(run_id)) & F.col("is_active") if codes else F.lit(False)


def deactivate_stale(events: DataFrame, runs: DataFrame, run_id: int) -> tuple[DataFrame, int]:
    """Events after the run's unseen ones of its source and scope became inactive, and how many did.

    Raises for a run that does not prove a complete snapshot, before anything changes.
    """
    run = runs.where(F.col("id") == run_id).where(may_deactivate()).select("source_id", "finished_at", scope_codes(F.col("scope")).alias("codes")).take(1)
    if not run:
        raise ValueError(f"run {run_id} is no complete, successful snapshot of a known scope")
    stale = (F.col("source_id") == run[0]["source_id"]) & F.coalesce(unseen(run_id, run[0]["codes"]), F.lit(False))
    marked = events.withColumn("_stale", stale)
    n = marked.where("_stale").count()
    after = marked.withColumn("is_active", F.when(F.col("_stale"), False).otherwise(F.col("is_active")))
    return after.withColumn("updated_at", F.when(F.col("_stale"), F.lit(run[0]["finished_at"])).otherwise(F.col("updated_at"))).drop("_stale"), n


def started(runs: DataFrame, source_id: int, scope: str, at: Column) -> DataFrame:
    """The ledger with one more running run, its id one above the greatest."""
    next_id = (runs.agg(F.max("id")).first()[0] or 0) + 1
    new = {"id": F.lit(next_id), "source_id": F.lit(source_id), "status": F.lit("running"), "scope": F.lit(scope), "started_at": at, "is_complete_snapshot": F.lit(False), "created_at": at}
    kinds = {f.name: f.dataType for f in runs.schema}
    row = runs.sparkSession.range(1).select(*(new.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in runs.columns))
    return runs.unionByName(row)


def source_status(runs: DataFrame, key: str, at: str, items: str, failed: Column, message: str) -> DataFrame:
    """A row per source after its runs: last check and item count, last success, failures since it, and their last message.

    One aggregate, combined before the shuffle: failures after the last success are counted by a second pass on the keyed join
    with that moment, so no source's runs are ordered in one place.
    """
    bad = failed
    last = runs.groupBy(key).agg(
        F.max(at).alias("last_checked_at"), F.max_by(items, at).alias("last_item_count"), F.max(F.when(~bad, F.col(at))).alias("last_success_at")
    )
    since = runs.withColumn("_bad", bad).join(last.select(key, "last_success_at"), key)
    after = F.col("_bad") & (F.col("last_success_at").isNull() | (F.col(at) > F.col("last_success_at")))
    streak = since.groupBy(key).agg(F.count_if(after).alias("error_count"), F.max_by(F.when(after, F.col(message)), F.when(after, F.col(at))).alias("error_message"))
    return last.join(streak, key)
