"""List rows and details to normalized events, in column expressions after one left join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import period, text, url

#: Labels of list cards and detail pages.
REGISTRATION, COURSE, CAPACITY, PLACE, FEE, CATEGORY = "접수기간", "강좌기간", "모집정원", "장소", "이용료", "분류"
DETAIL_FEES, DETAIL_STATUS, TARGET, METHOD, PLACE_NAME = ("요금", "이용요금"), "접수현황", "대상", "예약방법", "장소명"
_TAKEN = r"(\d+)\s*/\s*(\d+)"


def _of(map_: str, *keys: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(F.col(map_), F.lit(k)), F.lit("")) for k in keys))


def list_items(cards: DataFrame, hosts: tuple[str, ...], base: str) -> DataFrame:
    """Typed list items from sources.html.with_cards() rows; parse_error names what is impossible in a row."""
    c = cards.withColumn("_l", text.label_values(F.col("labels"))).withColumn("detail_url", url.canonical(F.col("href"), hosts, F.lit(base)))
    kind, event_id = url.resource(F.col("detail_url"), hosts)
    registration, course, capacity = _of("_l", REGISTRATION), _of("_l", COURSE), _of("_l", CAPACITY)
    c = c.withColumn("_r", period.date_range(registration)).withColumn("_e", period.date_range(course))
    keep = [x for x in cards.columns if x not in ("title", "place", "href", "image", "labels", "status", "fee_type3", "fee_type4", "method")]
    fee = F.coalesce(_of("_l", FEE), "fee_type3", "fee_type4")
    return c.select(
        *keep, "title", F.col("place").alias("organizer"), F.coalesce(_of("_l", PLACE), "place").alias("venue"), event_id.alias("source_event_id"), kind.alias("resource_kind"),
        (kind == "external").alias("is_external"), "detail_url", F.col("detail_url").alias("reservation_url"),
        F.when(F.col("image") != "", url.canonical(F.col("image"), hosts, F.lit(base))).alias("image_url"),
        F.col("_r.start").alias("registration_start"), F.col("_r.end").alias("registration_end"), registration.alias("registration_period_text"),
        F.col("_e.start").alias("event_start"), F.col("_e.end").alias("event_end"), course.alias("event_period_text"),
        text.plain_integer(capacity).alias("capacity"), capacity.alias("capacity_text"), fee.alias("fee_text"), text.free_value(fee).alias("is_free"),
        F.col("status").alias("registration_status_text"), F.col("method").alias("application_method_text"), _of("_l", CATEGORY).alias("original_category"),
        F.coalesce("_r.error", "_e.error").alias("parse_error"),
    )


def details(pages: DataFrame, hosts: tuple[str, ...] = ()) -> DataFrame:
    """Typed details from sources.html.with_details() rows.

    With a column detail_url, the url that a page was asked for, its resource must be the page's own: another id or another kind is an
    error, and the detail is known by the url's id, so that it reaches the item that asked.
    """
    guard, known_as = F.lit(None).cast("string"), F.col("resource_id")
    if "detail_url" in pages.columns:
        kind, asked = url.resource(F.col("detail_url"), hosts)
        said = F.regexp_extract("resource_id", "^[A-Z]+", 0)
        guard = F.when(kind == "external", "url of no resource").when(said != kind, F.concat(F.lit("expected a resource of kind "), kind, F.lit(", found "), F.col("resource_id"))).when(
            asked != F.col("resource_id"), F.concat(F.lit("expected resource "), asked, F.lit(", found "), F.col("resource_id"))
        )
        known_as = F.coalesce(asked, F.col("resource_id"))
    d = pages.where("resource_id is not null").withColumn("_r", period.datetime_range(_of("fields", REGISTRATION))).withColumn("_e", period.datetime_range(_of("fields", COURSE)))
    taken, lecture = _of("fields", DETAIL_STATUS), F.col("resource_id").startswith("LEC_")
    number = lambda k: F.when(lecture & taken.rlike(_TAKEN), F.regexp_extract(taken, _TAKEN, k).try_cast("int"))
    fee = _of("fields", *DETAIL_FEES)
    target = F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(text.target_summary(_of("fields", TARGET)), text.target_lines(F.col("description"))))), "\n"), F.lit(""))
    return d.select(
        known_as.alias("resource_id"), "title", "organizer", "description", "address", F.transform("active_dates", lambda x: F.try_to_date(x, "yyyy-MM-dd")).alias("active_dates"),
        F.coalesce(_of("fields", PLACE_NAME, PLACE)).alias("venue"), target.alias("target_text"), _of("fields", METHOD).alias("application_method"),
        F.col("_r.start").alias("registration_start"), F.col("_r.end").alias("registration_end"), _of("fields", REGISTRATION).alias("registration_period_text"),
        F.col("_e.start").alias("event_start"), F.col("_e.end").alias("event_end"), _of("fields", COURSE).alias("event_period_text"),
        number(1).alias("reserved_count"), number(2).alias("capacity"), taken.alias("capacity_text"), fee.alias("fee_text"), text.free_value(fee).alias("is_free"),
        F.coalesce(F.when(~F.col("resource_id").rlike(url.RESOURCE_ID), "invalid resource id"), guard, F.when(F.size("fields") == 0, "no summary fields"), "_r.error", "_e.error").alias("parse_error"),
    )


def events(items: DataFrame, found: DataFrame, source_code: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One normalized event per list item; external items and items whose detail failed keep list data alone.

    keep: columns of items that stay, as page and pos. parse_error is for a rule of the ingest: what it names must not be stored.
    """
    good = found.where("parse_error IS NULL")  # issues() tells of the others
    d = good.select(F.col("resource_id").alias("_id"), F.struct(*(c for c in found.columns if c != "resource_id")).alias("d"))
    j = items.join(d, (items["source_event_id"] == d["_id"]) & ~items["is_external"], "left").drop("_id")
    has = F.col("d").isNotNull()

    def either(name: str, listed: str | None = None) -> Column:
        return F.coalesce(F.col(f"d.{name}"), F.col(listed or name))

    def only_detail(name: str) -> Column:
        return F.when(has, F.col(f"d.{name}")).otherwise(F.col(name))

    bounds = [x for b in ("event_start", "event_end", "registration_start", "registration_end") for x in (
        F.col(f"d.{b}").alias(b), period.date_unless_known(F.col(f"d.{b}"), F.col(b)).alias(f"{b}_date"))]
    is_free = either("is_free")
    return j.select(
        *keep, url.item_key(F.col("source_event_id"), F.col("detail_url")).alias("source_item_key"), "source_event_id", "resource_kind", F.lit(source_code).alias("source_code"),
        either("title").alias("title"), F.col("d.description").alias("description"), either("organizer").alias("organizer"), either("venue").alias("venue"),
        F.col("d.address").alias("address"), "original_category", F.col("d.target_text").alias("target_text"), *bounds,
        either("event_period_text").alias("event_period_text"), only_detail("registration_period_text").alias("registration_period_text"),
        F.col("registration_status_text").alias("registration_status"), either("application_method", "application_method_text").alias("application_method"),
        only_detail("capacity").alias("capacity"), either("capacity_text").alias("capacity_text"), F.when(has & (F.col("d.is_free") == True), F.lit(0)).cast("decimal(12,2)").alias("fee"),  # noqa: E712
        either("fee_text").alias("fee_text"), is_free.alias("is_free"), "reservation_url", "detail_url", "image_url", F.col("detail_url").alias("source_url"),
        (has | F.col("is_external")).alias("detail_complete"), "parse_error",
    )


def occurrence_requests(found: DataFrame, cap: int | None = None) -> DataFrame:
    """resource_id and day of each slot page to fetch. With a cap, items with more active dates ask for none (date_errors)."""
    ready = found.where(F.size("active_dates") <= cap) if cap is not None else found
    return ready.select("resource_id", F.explode("active_dates").alias("day")).where("day is not null")


def slots_of(requests: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Requests with what came back: slots, how many are good, and errors (those of slots, or that nothing came back)."""
    got = occurrences.groupBy("resource_id", "day").agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("error").isNull()).alias("good"), F.array_sort(F.collect_set("error")).alias("errors"))
    joined = requests.join(got, ["resource_id", "day"], "left")
    none = F.coalesce(F.col("slots"), F.lit(0)) == 0
    return joined.select(
        "resource_id", "day", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("good", F.lit(0)).alias("good"),
        F.when(none, F.array(F.lit("no answer"))).otherwise(F.col("errors")).alias("errors"),
    )


def date_errors(found: DataFrame, cap: int | None = None) -> DataFrame:
    """resource_id and error of details whose active dates can't all be asked for: impossible ones, or more than the cap."""
    bad = F.when(F.exists("active_dates", lambda x: x.isNull()), F.lit("invalid active date"))
    if cap is not None:
        bad = F.coalesce(bad, F.when(F.size("active_dates") > cap, F.concat(F.size("active_dates").cast("string"), F.lit(f" active dates, more than {cap}"))))
    return found.select("resource_id", bad.alias("error")).where("error is not null")


def issues(items: DataFrame, found: DataFrame, key: list[str], answers: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """All that went wrong below the list pages, as one relation: key, page, phase, identifier, message and issue (text.issue of the three).

    items: list_items() rows with key and page; found: details() rows; answers: slots_of() rows. phase is `list` for an item that is
    impossible, `detail` for an internal item without a detail or with an impossible one, `dates` for active dates that can't be
    asked for and `slots` for requests without an answer or with bad slots. What a detail lacks counts on each page that lists it.
    """
    own = [*key, "page"]
    listed = items.where("parse_error IS NOT NULL").select(*own, F.lit("list").alias("phase"), F.coalesce("source_event_id", "detail_url").alias("identifier"), F.col("parse_error").alias("message"))
    inside = items.where("NOT is_external").select(*own, F.col("source_event_id").alias("resource_id"))
    got = found.groupBy("resource_id").agg(F.max(F.coalesce("parse_error", F.lit(""))).alias("_e"))
    failed = inside.join(got, "resource_id", "left").where("_e IS NULL OR _e <> ''").select(*own, F.lit("detail").alias("phase"), F.col("resource_id").alias("identifier"), F.coalesce("_e", F.lit("no detail")).alias("message"))
    dates = inside.join(date_errors(found, cap), "resource_id").select(*own, F.lit("dates").alias("phase"), F.col("resource_id").alias("identifier"), F.col("error").alias("message"))
    out = listed.unionByName(failed).unionByName(dates)
    if answers is not None:
        bad = answers.select("resource_id", "day", F.explode("errors").alias("error"))
        told = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(": "), "error")
        out = out.unionByName(inside.join(bad, "resource_id").select(*own, F.lit("slots").alias("phase"), F.col("resource_id").alias("identifier"), told.alias("message")))
    return out.withColumn("issue", text.issue(F.col("phase"), F.col("identifier"), F.col("message")))


def summary(normalized: DataFrame) -> DataFrame:
    """Counts per kind, and of details, in one pass."""
    kinds = [F.count_if(F.col("resource_kind") == k).alias(k.lower()) for k in ("LEC", "EXP", "DAY", "external")]
    return normalized.agg(F.count(F.lit(1)).alias("items"), *kinds, F.count_if(~F.col("detail_complete")).alias("detail_failures"))
