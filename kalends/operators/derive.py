"""Derived views: status at a moment, calendar markers, likely duplicates across sources, places nearby."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import staged

RADIUS_KM = 6371.0088
#: Segments of a text beyond those that edits can spoil, of which as many, the commonest, aren't filed.
SPARE = 2


def status_at(as_of: Column, opens: Column, closes: Column, starts: Column, ends: Column, closing_days: int = 3, onsite: Column | None = None) -> Column:
    """Registration first, then the event, from dates alone (so a date is never taken for midnight).

    onsite: whether people register at the place: such an event is 현장접수 while it lasts, and waits for its day without a closing date.
    """
    here = F.lit(False) if onsite is None else F.coalesce(onsite, F.lit(False))
    runs = (as_of >= starts) & (as_of <= ends)
    return (
        F.when(here & runs, "현장접수").when(as_of < opens, "접수예정").when((as_of >= opens) & (as_of == closes), "오늘마감")
        .when((as_of >= opens) & (as_of < closes) & (F.datediff(closes, as_of) <= closing_days), "마감임박").when((as_of >= opens) & (as_of < closes), "접수중")
        .when(as_of < starts, F.when((as_of > closes) & ~here, "접수마감").otherwise("행사예정")).when(runs, "행사중").when(as_of > ends, "종료")
    )


def calendar(df: DataFrame, key: str, markers: dict[str, str]) -> DataFrame:
    """A row per key and marker with a date: markers maps a marker's name to its date column."""
    pairs = ", ".join(f"'{m}', `{c}`" for m, c in markers.items())
    return df.selectExpr(key, f"stack({len(markers)}, {pairs}) AS (marker, day)").where("day IS NOT NULL")


def occurrence_markers(occurrences: DataFrame, key: str, start: str, zone: str = "Asia/Seoul") -> DataFrame:
    """Calendar rows of occurrences, one for each local day on which an event has any: key, marker and day, as calendar() gives."""
    day = F.to_date(F.from_utc_timestamp(F.col(start).cast("timestamp"), zone))
    return occurrences.select(key, F.lit("occurrence").alias("marker"), day.alias("day")).where("day IS NOT NULL").distinct()


def likeness(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length, 0 if either is null or empty."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.coalesce(F.when(longer > 0, 1 - F.levenshtein(a, b) / longer), F.lit(0.0))


def similar_texts(texts: DataFrame, block: list[str], text: str, unlike: float) -> DataFrame:
    """block, x, y: pairs of different texts of a block, x before y, whose edit distance is at most `unlike` times the longer length.

    A segment index. Let k be the most edits that a pair may have, by its longer text. The shorter one is cut into k + 3 segments, of
    which k edits leave three or more whole; these stand in the longer text at places that the difference of the lengths
    bounds. So each text files its segments, all but the two that are commonest (a beginning that all titles share, say), under block, lengths
    and number, and asks for the parts of itself that a shorter text's segments could be. Only texts that meet are measured.
    Texts of length 0, and null blocks or texts, are like none; where k is 0 only equal texts would be. A longer beginning that
    very many texts share costs time, not pairs.
    """
    if not 0 <= unlike <= 0.25:
        raise ValueError("unlike must be 0..0.25")
    own = texts.dropna(subset=[*block, text]).where(F.char_length(text) > 0).select(*block, F.col(text).alias("t")).distinct()
    own = staged(own.withColumns({"id": F.monotonically_increasing_id(), "n": F.char_length("t")}))
    edits = lambda n: F.floor(n * unlike + 1e-9).cast("int")
    key = lambda *more: F.xxhash64(*block, "short", "k", "i", *more)
    size = lambda: F.floor(F.col("short") / (F.col("k") + 1 + SPARE)).cast("int")
    # The first segments have `size` characters, the last ones one more.
    longer = F.col("k") + 1 + SPARE - F.col("short") % (F.col("k") + 1 + SPARE)
    at = F.col("i") * size() + F.greatest(F.lit(0), F.col("i") - longer)
    width = size() + (F.col("i") >= longer).cast("int")
    filed = own.withColumn("short", F.col("n")).withColumn("most", F.floor(F.col("n") / (1 - unlike) + 1e-9).cast("int"))
    filed = filed.withColumn("k", F.explode(F.sequence(edits(F.col("n")), edits(F.col("most"))))).where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") + SPARE)))
    filed = filed.select("id", "k", "i", key(F.substring(F.col("t"), at + 1, width)).alias("h"))
    common = filed.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("id", "k").orderBy(F.desc("times"), "i"))
    filed = filed.join(common, "h").withColumn("rank", rank).where(F.col("rank") > SPARE).select(F.col("id").alias("a"), "h")
    asked = own.withColumn("k", edits(F.col("n"))).where("k > 0").withColumn("short", F.explode(F.sequence(F.col("n") - F.col("k"), F.col("n"))))
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") + SPARE)))
    gap = F.col("n") - F.col("short")
    slack = F.floor((F.col("k") - gap) / 2).cast("int")
    first, last = F.greatest(F.lit(0), at - slack), F.least(F.col("n") - width, at + gap + slack)
    asked = asked.where(first <= last).withColumn("from", F.explode(F.sequence(first, last)))
    asked = asked.select(F.col("id").alias("b"), key(F.substring(F.col("t"), F.col("from") + 1, width)).alias("h"))
    met = filed.join(asked, "h").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (own.select(F.col("id").alias(c), F.struct(*block).alias(f"{c}_block"), F.col("t").alias(f"{c}_t"), F.col("n").alias(f"{c}_n")) for c in "ab")
    near = met.join(a, "a").join(b, "b").where("a_block = b_block").withColumn("k", edits(F.greatest("a_n", "b_n")))
    near = near.where(F.expr("levenshtein(a_t, b_t)") <= F.col("k"))
    return near.select(*(F.col(f"a_block.{c}").alias(c) for c in block), F.least("a_t", "b_t").alias("x"), F.greatest("a_t", "b_t").alias("y"))


def duplicate_candidates(df: DataFrame, key: str, title: str, day: str, venue: str, organizer: str, source: str, least: float = 75) -> DataFrame:
    """Pairs of different sources scored 50 title, 25 same day, 15 same venue, 10 organizer; those of `least` (75 or more).

    Rows that agree in all but their key are one, named by the least key and with their number, so copies are neither
    compared nor paired again; a null agrees with nothing. Three ways lead to 75: equal titles on one day; titles four fifths
    alike on one day, which similar_texts() finds; half alike where day and venue agree, compared within those; and without the day, title, venue and organizer
    all the same. Each different title of a day is compared once, whatever number of rows has it.
    """
    if least < 75:
        raise ValueError("least must be 75 or more: pairs below may agree in nothing that can be looked up")
    parts = {"title": title, "day": day, "venue": venue, "organizer": organizer, "source": source}
    kinds = staged(df.groupBy(*(F.col(c).alias(n) for n, c in parts.items())).agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("copies")))
    a, b = (kinds.select(*(F.col(c).alias(f"{s}_{c}") for c in (*parts, "key", "copies"))) for s in "ab")
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    other = F.col("a_source") != F.col("b_source")
    equal = a.join(b, (F.col("a_day") == F.col("b_day")) & (F.col("a_title") == F.col("b_title")) & (F.col("a_key") < F.col("b_key")) & other)
    elsewhen = a.join(b, (F.col("a_title") == F.col("b_title")) & (F.col("a_venue") == F.col("b_venue")) & (F.col("a_organizer") == F.col("b_organizer")) & (F.col("a_key") < F.col("b_key")) & other)

    def spread(pairs: DataFrame, *block: str) -> DataFrame:
        """Rows whose titles are a pair's, in either order."""
        both = pairs.unionByName(pairs.select(*block, F.col("x").alias("y"), F.col("y").alias("x")))
        left = both.join(a, [both[c] == F.col(f"a_{c}") for c in block] + [F.col("x") == F.col("a_title")]).drop(*block, "x")
        return left.join(b, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in block] + [(F.col("y") == F.col("b_title")) & (F.col("a_key") < F.col("b_key")) & other]).drop("y")

    near = similar_texts(kinds, ["day"], "title", (85 - least) / 50)
    there = kinds.dropna(subset=["day", "venue", "title"]).select("day", "venue", "title").distinct()
    n, m = F.char_length("x"), F.char_length("y")
    close = there.withColumnRenamed("title", "x").join(there.withColumnRenamed("title", "y"), ["day", "venue"]).where((F.col("x") < F.col("y")) & (F.abs(n - m) * 50 <= F.greatest(n, m) * (100 - least)))
    close = close.where(F.levenshtein("x", "y") * 50 <= F.greatest(n, m) * (100 - least))
    pairs = equal.unionByName(elsewhen.where(~same("day"))).unionByName(spread(near, "day").where(~same("venue"))).unionByName(spread(close, "day", "venue"))
    sure = 25 * same("day").cast("int") + 15 * same("venue").cast("int")
    score = 50 * likeness(F.col("a_title"), F.col("b_title")) + sure + 10 * likeness(F.col("a_organizer"), F.col("b_organizer"))
    scored = pairs.select(F.col("a_key").alias(f"a_{key}"), F.col("b_key").alias(f"b_{key}"), "a_copies", "b_copies", F.round(score, 4).alias("score"))
    return scored.where(F.col("score") >= least).withColumn("verdict", F.when(F.col("score") >= 90, "auto").otherwise("review"))


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * RADIUS_KM * F.asin(F.sqrt(h))


def nearby(df: DataFrame, lat: str, lon: str, at: tuple[float, float], km: float) -> DataFrame:
    """Rows within km of a point; the bounding box on plain columns reaches the scan.

    The box is as wide as the circle is at its latitude nearest a pole, wraps at the date line, and takes all longitudes where
    a pole is within reach.
    """
    up = math.degrees(km / RADIUS_KM) * 1.0001
    box = df.where(F.col(lat).between(at[0] - up, at[0] + up))
    if abs(at[0]) + up < 90:
        side = math.degrees(math.asin(min(1.0, math.sin(math.radians(up)) / math.cos(math.radians(at[0])))))
        west, east = at[1] - side, at[1] + side
        inside = F.col(lon).between(west, east)
        if west < -180:
            inside = inside | (F.col(lon) >= west + 360)
        if east > 180:
            inside = inside | (F.col(lon) <= east - 360)
        box = box.where(inside)
    return box.withColumn("km", kilometres(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lon))).where(F.col("km") <= km)


def nearby_points(points: DataFrame, places: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """The columns of points and of places (other than lat and lon) and km, for each place within km of a point.

    A join on a grid: rows of cells are km high, and each row has as many cells around as keep them km wide where it is narrowest,
    so cells are alike everywhere and few at the poles. A place is filed under its own cell; a point asks for the cells that its
    circle touches, in its row and the two beside it, around the date line and over the poles. Then distances are measured. Rows without
    both coordinates are near nothing. Columns other than lat and lon must have different names.
    """
    up = math.degrees(km / RADIUS_KM) * 1.0001
    row = lambda at: F.floor(at / up).cast("long")

    def cells(r: Column) -> Column:
        """How many cells a row has around."""
        widest = F.greatest(F.abs(r * up), F.abs((r + 1) * up))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(widest, F.lit(90.0)))) / up)).cast("long")

    turned = lambda x: F.pmod(x + 180, F.lit(360.0))
    filed = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_row", row(F.col(lat)))
    filed = filed.withColumn("_cell", F.least(cells(F.col("_row")) - 1, F.floor(turned(F.col(lon)) * cells(F.col("_row")) / 360))).withColumnsRenamed({lat: "_lat2", lon: "_lon2"})
    reach = F.when(F.abs(lat) + up < 90, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(up)) / F.cos(F.radians(F.col(lat)))))) * 1.0001).otherwise(180.0)
    asked = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_reach", F.least(reach, F.lit(180.0))).withColumn("_row", F.explode(F.sequence(row(F.col(lat)) - 1, row(F.col(lat)) + 1)))
    n = cells(F.col("_row"))
    first, last = (F.floor((turned(F.col(lon)) + d * F.col("_reach")) * n / 360).cast("long") for d in (-1, 1))
    asked = asked.withColumn("_cell", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: F.pmod(c, n))))).withColumnsRenamed({lat: "_lat1", lon: "_lon1"})
    met = asked.join(filed, ["_row", "_cell"]).withColumn("km", kilometres(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))).where(F.col("km") <= km)
    return met.drop("_row", "_cell", "_reach", "_lat1", "_lon1", "_lat2", "_lon2")


def nearby_counts(points: DataFrame, places: DataFrame, key: str, lat: str, lon: str, kms: tuple[float, ...]) -> DataFrame:
    """key, within_<km> for each distance and nearest (km), for each key with a place within the greatest distance of a point of its own.

    Points that stand in one spot are measured once, and so are places: only different spots meet, with how many places stand there,
    and a point takes what was counted for its spot.
    """
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    points = points.where(known).select(F.col(key).alias("key"), F.col(lat).alias("a"), F.col(lon).alias("o"))
    asked = points.select("a", "o").distinct().withColumns({lat: F.col("a"), lon: F.col("o")})
    held = places.where(known).groupBy(lat, lon).agg(F.count(F.lit(1)).alias("n"))
    within = lambda d: F.sum(F.when(F.col("km") <= d, F.col("n")).otherwise(0))
    spots = nearby_points(asked, held, lat, lon, max(kms)).groupBy("a", "o").agg(*(within(d).alias(f"within_{d}") for d in kms), F.min("km").alias("nearest"))
    of = points.join(spots, ["a", "o"]).groupBy("key").agg(*(F.sum(f"within_{d}").alias(f"within_{d}") for d in kms), F.min("nearest").alias("nearest"))
    return of.withColumnRenamed("key", key)


def running(df: DataFrame, start: str, end: str, by: str) -> DataFrame:
    """by, day and n: how many rows run on each day, from a group's first day to its last, days without any among them.

    A sweep line: a row adds one on its first day and takes it away behind its last one, and days sum up what came before, by month
    and then within it. No row is repeated for its days. A row without an end runs on its first day; one that ends before it
    starts, or has no start or no group, on none.
    """
    known = df.where(F.col(by).isNotNull()).select(by, F.col(start).cast("date").alias("a"), F.coalesce(F.col(end).cast("date"), F.col(start).cast("date")).alias("z")).where("a IS NOT NULL AND z >= a")
    moves = known.select(by, F.explode(F.array(F.struct(F.col("a").alias("day"), F.lit(1).alias("move")), F.struct(F.date_add("z", 1).alias("day"), F.lit(-1).alias("move")))).alias("m"))
    moves = moves.groupBy(by, "m.day").agg(F.sum("m.move").alias("move")).withColumn("month", F.trunc("day", "month"))
    months = moves.groupBy(by, "month").agg(F.sum("move").alias("moved"))
    spans = moves.groupBy(by).agg(F.min("day").alias("from"), F.date_sub(F.max("day"), 1).alias("upto"))
    days = spans.select(by, F.explode(F.sequence("from", "upto")).alias("day")).withColumn("month", F.trunc("day", "month"))
    every = days.select(by, "month").distinct().join(months, [by, "month"], "left")
    before = every.withColumn("before", F.sum(F.coalesce("moved", F.lit(0))).over(Window.partitionBy(by).orderBy("month")) - F.coalesce("moved", F.lit(0))).drop("moved")
    inside = Window.partitionBy(by, "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    summed = days.join(moves.drop("month"), [by, "day"], "left").withColumn("inside", F.sum(F.coalesce("move", F.lit(0))).over(inside))
    return summed.join(before, [by, "month"]).select(by, "day", (F.col("before") + F.col("inside")).alias("n"))


def day_counts(as_of: Column, opens: Column, closes: Column, starts: Column) -> list[Column]:
    """Days until registration opens and closes and the event starts, and what holds today; null where a date is."""
    return [
        F.datediff(opens, as_of).alias("days_to_open"), F.datediff(closes, as_of).alias("days_to_close"), F.datediff(starts, as_of).alias("days_to_start"),
        (opens == as_of).alias("opens_today"), (closes == as_of).alias("closes_today"), F.dayofweek(starts).isin(1, 7).alias("on_weekend"),
    ]


def closing_soon(df: DataFrame, as_of: Column, opens: str, closes: str, days: int = 3) -> DataFrame:
    """Rows whose registration is open and closes within so many days, with the days left."""
    left = F.datediff(F.col(closes), as_of)
    return df.where((F.col(opens) <= as_of) & left.between(0, days)).withColumn("days_left", left)


def openings(df: DataFrame, as_of: Column, opens: str, closes: str, soon_days: int = 7) -> DataFrame:
    """Rows whose registration opens within so many days, is open, or closes within three: phase, days_left and rank.

    phase is opening_soon, open_now or closing_soon; rank puts what ends or begins first ahead within its phase.
    """
    start, end = F.datediff(F.col(opens), as_of), F.datediff(F.col(closes), as_of)
    phase = F.when(start.between(1, soon_days), "opening_soon").when((start <= 0) & end.between(0, 3), "closing_soon").when((start <= 0) & (end > 3), "open_now")
    return df.withColumns({"phase": phase, "days_left": F.when(start > 0, start).otherwise(end)}).where("phase is not null")


#: A method's name and the words of a source that mean it, the first that is found.
METHODS = {
    "prerequisite": ("선행", "사전 미션"), "first_come": ("선착순",), "lottery": ("추첨",), "phone_registration": ("전화",),
    "onsite_registration": ("현장",), "walk_in": ("자유입장", "자유관람"), "online_reservation": ("온라인", "인터넷"),
}
#: Words for an age group, its search tag and the ages it stands for (null: open).
AGES = (
    ("미취학", "유아", None, 6), ("유아", "유아", None, 6), ("초등 저학년", "초등", 7, 9), ("초등 고학년", "초등", 10, 12), ("초등", "초등", 7, 12), ("어린이", "초등", 7, 12),
    ("중학생", "청소년", 13, 15), ("고등학생", "청소년", 16, 18), ("청소년", "청소년", 13, 18), ("성인", "성인", 19, None), ("어르신", "시니어", 65, None), ("시니어", "시니어", 65, None),
    ("가족", "가족", None, None),
)


def method(text: Column) -> Column:
    """The standard name of an application method, null if no word of it is known."""
    found = [F.when(reduce(or_, (text.contains(w) for w in words)), name) for name, words in METHODS.items()]
    return F.coalesce(*found)


def ages(text: Column) -> Column:
    """Struct (age_min, age_max, tags) of a text on who may take part; the text itself stays what counts.

    Ages that are written ("8~10세", "만 6세 이상") come before those of words; an open end is null.
    """
    span, least, most = r"(\d{1,2})\s*세?\s*[~-]\s*(\d{1,2})\s*세", r"(\d{1,2})\s*세\s*이상", r"(\d{1,2})\s*세\s*(?:이하|까지)"

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("int")

    known, tags, rest = [], [], text
    for word_, tag, a, b in AGES:  # a word that is part of another is looked for in what that one leaves
        hit = rest.contains(word_)
        known.append(F.when(hit, F.struct(F.lit(a).cast("int").alias("a"), F.lit(b).cast("int").alias("b"))))
        tags.append(F.when(hit, tag))
        rest = F.replace(rest, F.lit(word_), F.lit(" "))
    word = F.array_compact(F.array(*known))
    low = F.when(F.exists(word, lambda x: x["a"].isNull()), F.lit(None).cast("int")).otherwise(F.array_min(F.transform(word, lambda x: x["a"])))
    high = F.when(F.exists(word, lambda x: x["b"].isNull()), F.lit(None).cast("int")).otherwise(F.array_max(F.transform(word, lambda x: x["b"])))
    written = text.rlike(f"{span}|{least}|{most}")
    return F.struct(
        F.when(written, F.coalesce(number(span, 1), number(least, 1))).otherwise(low).alias("age_min"),
        F.when(written, F.coalesce(number(span, 2), number(most, 1))).otherwise(high).alias("age_max"), F.array_distinct(F.array_compact(F.array(*tags))).alias("tags"),
    )


def period(as_of: Column, name: str) -> tuple[Column, Column]:
    """First and last day of a named period: this or next week (Monday first), weekend or month."""
    monday = F.date_sub(as_of, F.weekday(as_of))
    first = F.trunc(as_of, "month")
    known = {
        "this_week": (monday, F.date_add(monday, 6)), "this_weekend": (F.date_add(monday, 5), F.date_add(monday, 6)),
        "next_week": (F.date_add(monday, 7), F.date_add(monday, 13)), "next_weekend": (F.date_add(monday, 12), F.date_add(monday, 13)),
        "this_month": (first, F.last_day(as_of)), "next_month": (F.add_months(first, 1), F.last_day(F.add_months(first, 1))),
    }
    return known[name]


def search(
    df: DataFrame, as_of: Column, districts: tuple[str, ...] = (), within: str | None = None, statuses: tuple[str, ...] = (), tags: tuple[str, ...] = (),
    free: bool | None = None, methods: tuple[str, ...] = (),
) -> DataFrame:
    """Rows that meet every filter given: district, days that meet a named period, status, one of the tags, price, method.

    df: district, event_start_date, event_end_date, status, tags (array), is_free, method. Plain columns reach the scan.
    """
    if districts:
        df = df.where(F.col("district").isin(*districts))
    if within:
        first, last = period(as_of, within)
        df = df.where((F.col("event_start_date") <= last) & (F.coalesce("event_end_date", "event_start_date") >= first))
    if statuses:
        df = df.where(F.col("status").isin(*statuses))
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if free is not None:
        df = df.where(F.col("is_free") == free)
    return df.where(F.col("method").isin(*methods)) if methods else df


def cadence(runs: DataFrame, key: str, at: str, expected_hours: float = 24.0) -> DataFrame:
    """Per source: runs, first and last moment, mean hours between runs, and whether that is above what is expected."""
    got = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    hours = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 3.6e9 / F.when(F.col("n") > 1, F.col("n") - 1)
    return got.withColumn("mean_hours", hours).withColumn("late", F.col("mean_hours") > expected_hours)


class Snapshot:
    """A state of a table for dashboard(): rows in buckets by key, and for each bucket and group how many there are and sums of their hashes.

    Sums don't depend on order, so two states of a bucket are told apart without reading a row. Build it when a version is written.
    """

    def __init__(self, df: DataFrame, key: list[str], digest: str, by: str, buckets: int = 64):
        self.key, self.by, self.buckets = key, by, buckets
        rows = df.select(*key, F.col(by).alias("by"), F.col(digest).alias("digest"), F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket"))
        self.rows = staged(rows.repartition("bucket"), ("bucket",))
        # Halves of two hashes: each sum fits a long for two thousand million rows.
        hashes = [F.xxhash64(*key, "digest", "by", F.lit(salt)) for salt in (1, 2)]
        halves = [f(h) for h in hashes for f in (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32))]
        self.digests = staged(self.rows.groupBy("bucket", "by").agg(F.count(F.lit(1)).alias("n"), *(F.sum(h).alias(f"h{i}") for i, h in enumerate(halves))))

    def changed(self, other: Snapshot) -> list[int]:
        """Buckets in which the states differ, `buckets` at most."""
        both = self.digests.unionByName(other.digests)
        same = both.groupBy(*both.columns).count().where("count % 2 = 1")
        return [r[0] for r in same.select("bucket").distinct().collect()]


def dashboard(before: Snapshot, after: Snapshot) -> DataFrame:
    """Per group: how many rows are new, changed (another digest), gone or the same between two states.

    Only buckets that differ are read and joined; the rows of the others are the same, and their digests say how many they are.
    """
    if (before.key, before.by, before.buckets) != (after.key, after.by, after.buckets):
        raise ValueError("states of one table must be cut alike")
    differ = F.col("bucket").isin(before.changed(after))
    b, a = (s.rows.where(differ).select(*s.key, F.struct("by", "digest").alias(n)) for s, n in ((before, "b"), (after, "a")))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a.digest").eqNullSafe(F.col("b.digest")), "same").otherwise("changed")
    joined = b.join(a, before.key, "full").select(F.when(F.col("a").isNotNull(), F.col("a.by")).otherwise(F.col("b.by")).alias("by"), kind.alias("kind"))
    counted = joined.groupBy("by").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("new", "changed", "gone", "same")))
    kept = after.digests.where(~differ).select("by", *(F.lit(0).cast("long").alias(k) for k in ("new", "changed", "gone")), F.col("n").alias("same"))
    whole = counted.unionByName(kept).groupBy("by").agg(*(F.sum(k).alias(k) for k in ("new", "changed", "gone", "same")))
    return whole.withColumnRenamed("by", before.by)


def admin_totals(events: DataFrame, runs: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """One row for a day: events collected on it, events that ended before it, runs that failed on it, and pairs that may be duplicates.

    events: collected_at, event_start_date, event_end_date; runs: finished_at, status; candidates: duplicate_candidates().
    """
    over = F.coalesce("event_end_date", "event_start_date") < as_of
    one = events.agg(F.count_if(F.to_date("collected_at") == as_of).alias("collected"), F.count_if(over).alias("ended"))
    two = runs.agg(F.count_if((F.to_date("finished_at") == as_of) & (F.col("status") == "failed")).alias("failed_runs"))
    three = candidates.agg(F.count_if(F.col("verdict") == "auto").alias("duplicates"), F.count_if(F.col("verdict") == "review").alias("to_review"))
    numbered = [d.withColumn("_", F.lit(0)) for d in (one, two, three)]  # a row each
    return numbered[0].join(numbered[1], "_").join(numbered[2], "_").drop("_")


def health(status: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Adds health to source_status() rows: 오류 if nothing succeeded within so many days, 경고 after a failure, else 정상."""
    stale = F.coalesce(F.datediff(as_of, F.to_date("last_success_at")) > days, F.lit(True))
    return status.withColumn("health", F.when(stale, "오류").when(F.col("error_count") > 0, "경고").otherwise("정상"))


#: Fixed value: the category of what no rule tells.
OTHER = "기타"
#: Bytes of rules, about, that every task gets, and bits of the bitmap that stands for the others.
NEAR_BYTES, SLOTS = 64 << 20, 1 << 26


def words(text: Column, limit: int = -1) -> Column:
    """Runs of other characters than ASCII white space; with a limit, the last entry is the rest behind limit - 1 words. A text without any has one empty word."""
    return F.split(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", limit)


def categories(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """key and category of each key: that of the longest rule whose words stand in the text in a row, else OTHER.

    rules: pattern (words with single spaces), category, priority. Of rules with equally many words the one with more characters
    counts, then the lesser priority, then the lesser category, nulls last. Words are runs of other characters than ASCII white space, compared as
    they are. Rows that share a key are one; null texts and patterns match nothing.

    Of the rules of one pattern only the first can win, so there is one of each, numbered in the order above. A run of words is looked up
    by its hash and then compared, and a text keeps the least number: a row for each text is shuffled, not its words. Every task gets the patterns that most rules
    share and the shortest, up to NEAR_BYTES; runs that may be one of the others, by a bitmap of hashes, are shuffled to them.
    """
    first = lambda c: [F.col(c).isNull(), F.col(c)]
    one = rules.where(F.trim("pattern") != "").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("priority", "category"), F.struct(*first("priority"), *first("category"))).alias("r"),
    )
    one = staged(one.select("pattern", "copies", "r.*", F.size(F.split("pattern", " ")).alias("n"), F.xxhash64(F.split("pattern", " ")).alias("h")))
    order = [-F.col("n"), -F.char_length("pattern"), *first("priority"), *first("category"), "pattern"]
    known = staged(one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()))
    kinds = [-F.least("copies", F.lit(1000)), F.least("n", F.lit(10)), F.least(F.octet_length("pattern"), F.lit(100))]
    known = known.withColumn("kind", F.struct(*(c.cast("int").alias(f"k{i}") for i, c in enumerate(kinds))))
    sizes = sorted(r[0] for r in known.select("n").distinct().collect())  # as many as the longest rule has words
    last, taken, whole = None, 0, True
    for kind, size in sorted((tuple(r[0]), r[1]) for r in known.groupBy("kind").agg(F.sum(F.octet_length("pattern") + 100)).collect()):
        if whole := (taken := taken + size) <= NEAR_BYTES:
            last = kind
        else:
            break
    near = F.lit(False) if last is None else F.col("kind") <= F.struct(*(F.lit(k) for k in last))

    cut = texts.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).select("key", "w", F.posexplode_outer("w").alias("at", "_"))
    hashes = F.array(*(F.when(F.col("at") + n <= F.size("w"), F.xxhash64(F.slice("w", F.col("at") + 1, n))) for n in sizes), F.lit(None).cast("long"))
    runs_ = cut.select("key", "w", "at", F.posexplode(hashes).alias("i", "h"))
    run = F.array_join(F.slice("w", F.col("at") + 1, F.get(F.array(*map(F.lit, sizes)), F.col("i"))), " ")
    found = texts.select(F.col(key).alias("key"), F.lit(None).cast("long").alias("rank"))
    if last is not None:
        hits = runs_.join(F.broadcast(known.where(near).select("h", "pattern", "rank")), "h")
        found = found.unionByName(hits.select("key", F.when(run == F.col("pattern"), F.col("rank")).alias("rank")))  # compared behind the join, so its key is a number
    if not whole:
        far = known.where(~near).select("h", "pattern", "rank")
        slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1))
        word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
        filled = far.groupBy(word.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        every = texts.sparkSession.range(SLOTS // 64).join(filled, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("s"))
        bitmap = every.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["bits"])).scalar()
        maybe = runs_.where(F.call_function("shiftright", F.get(bitmap, word.cast("int")), bit).bitwiseAND(F.lit(1)) == 1)
        found = found.unionByName(maybe.select("key", run.alias("pattern")).join(far, "pattern").select("key", "rank"))
    best = found.groupBy("key").agg(F.min("rank").alias("rank"))
    named = best.join(known.select("rank", "category"), "rank", "left")
    return named.select(F.col("key").alias(key), F.coalesce("category", F.lit(OTHER)).alias("category"))


def stale_days(as_of: Column, verified: Column, limit: int = 7) -> list[Column]:
    """Days since a row was last verified, and whether that is too long ago (never verified is)."""
    age = F.datediff(as_of, verified)
    return [age.alias("age_days"), F.coalesce(age > limit, F.lit(True)).alias("stale")]
