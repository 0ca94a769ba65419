"""Paged reads and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources.store import in_order

DEFAULT_LIMIT, MAX_LIMIT = 20, 100


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    """Rows whose flag is true; null is not."""
    return df.where(F.col(flag).eqNullSafe(True))


def _check(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError("limit must be 1..100 and offset 0 or more")


def page(df: DataFrame, start: str, key: str, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Rows by start, those without one last, then by key: Spark keeps offset + limit rows per task, no full sort.

    For pages far down see RankIndex.
    """
    _check(limit, offset)
    return df.orderBy(F.col(start).asc_nulls_last(), F.col(key).asc()).offset(offset).limit(limit)


class RankIndex:
    """Rows in slices that follow one another in the order of page(), with how many rows each has.

    A page at any depth then reads the one slice, or the few, that hold it and sorts those alone; the driver keeps a number for each
    slice. Build it once for a table that many pages are read from.
    """

    def __init__(self, df: DataFrame, start: str, key: str, per_slice: int = 100_000):
        self.order = [F.col(start).asc_nulls_last(), F.col(key).asc()]
        self.rows = in_order(df, self.order, per_slice, partition_by=True)
        self.sizes = sorted((r["_slice"], r["count"]) for r in self.rows.groupBy("_slice").count().collect())

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def page(self, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        """The rows that page() gives."""
        _check(limit, offset)
        before, first, held = 0, None, []
        for number, n in self.sizes:
            if before < offset + limit and before + n > offset:
                first = before if first is None else first
                held.append(number)
            before += n
        return self.rows.where(F.col("_slice").isin(held)).drop("_slice").orderBy(*self.order).offset(offset - (first or 0)).limit(limit)


def envelope(df: DataFrame, start: str, key: str, limit: int = DEFAULT_LIMIT, offset: int = 0) -> dict:
    """items, total, limit and offset of a page, ready for JSON."""
    items = [r.asDict(recursive=True) for r in page(df, start, key, limit, offset).collect()]
    return {"items": items, "total": df.count(), "limit": limit, "offset": offset}


def representatives(df: DataFrame, kind: str, order: str, n: int = 3) -> DataFrame:
    """Up to n rows: the first of each kind in order of appearance, then others in order.

    The first of each kind comes from an aggregate, so no kind is sorted as a whole.
    """
    first = df.groupBy(kind).agg(F.min(order).alias("_first"))
    marked = df.join(F.broadcast(first.orderBy("_first").limit(n)), (df[kind].eqNullSafe(first[kind])) & (df[order] == first["_first"]), "left").drop(first[kind])
    return marked.orderBy(F.col("_first").isNull(), F.col(order)).limit(n).drop("_first")


def nested_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str = "children") -> DataFrame:
    """Parents with an ordered array of their children, empty where there are none."""
    fields = [c for c in children.columns if c != key]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in fields if c not in order)))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def shown_date(at: Column, day: Column, zone: str = "Asia/Seoul") -> Column:
    """What a card shows: local date and time, else the date, else that there is none yet."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy. M. d. HH:mm"), F.date_format(day, "yyyy. M. d."), F.lit("일정 미정"))


def shown_organizer(organizer: Column) -> Column:
    return F.coalesce(organizer, F.lit("주최 기관 미정"))


def sample(df: DataFrame, nested: str = "children", drop: tuple[str, ...] = ("description",), shown: int = 2) -> DataFrame:
    """What a dry run shows of a row: without long columns, the nested rows as their count and the first few."""
    return df.drop(*drop).withColumns({f"{nested}_count": F.size(nested), nested: F.slice(nested, 1, shown)})


def read_model(events: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Events in the columns that readers get, with their occurrences in order of start and id."""
    own = [c.split()[0] for c in schemas.READ_COLUMNS]
    lists = occurrences.select(F.col("event_id").alias("id"), *(c.split()[0] for c in schemas.READ_OCCURRENCE))
    return nested_children(events.select(*own), lists, "id", ["start_at", "source_occurrence_id"], "occurrences")
