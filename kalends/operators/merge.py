"""Keyed merges of a batch into a table: one join, an action per row, columns chosen by action."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import hashing
from ..sources.store import staged

ACTIONS = ("insert", "update", "touch", "keep")


def last_wins(batch: DataFrame, key: list[str], order: str, complete: str | None = None) -> DataFrame:
    """One row per key: the last in order; with complete, the last complete row, or else the first of all.

    The struct aggregate combines before the shuffle, so a key that fills a batch costs each task one row.
    """
    others = [c for c in batch.columns if c not in key]
    row = F.struct(*others)
    if complete is None:
        chosen = F.max_by(row, F.col(order))
    else:
        rank = F.when(F.coalesce(F.col(complete), F.lit(False)), F.col(order))
        chosen = F.coalesce(F.max_by(row, rank), F.min_by(row, F.col(order)))
    return batch.groupBy(*key).agg(chosen.alias("_row")).select(*key, *(F.col("_row")[c].alias(c) for c in others))


def actions(base: DataFrame, delta: DataFrame, key: list[str], complete: Column | None = None) -> DataFrame:
    """base full-outer-joined with delta: key, b (struct of base), d (struct of delta) and action.

    insert: only in delta; update: in both; touch: in both but the delta row is incomplete; keep: only in base.
    """
    b = base.select(*key, F.struct(*base.columns).alias("b"))
    d = delta.select(*key, F.struct(*delta.columns).alias("d"))
    whole = F.lit(True) if complete is None else F.coalesce(complete, F.lit(False))
    action = F.when(F.col("d").isNull(), "keep").when(F.col("b").isNull(), "insert").when(whole, "update").otherwise("touch")
    return b.join(d, key, "full").withColumn("action", action)


def merged(joined: DataFrame, columns: Iterable[str], updated: Iterable[str], touched: Iterable[str] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """The table after the merge, with its action column.

    updated: columns that an update takes from the delta; touched: those that a touch takes. An insert takes all that the
    delta has, and defaults or null for the rest.
    """
    updated, touched, defaults = set(updated), set(touched), defaults or {}
    have = joined.schema["d"].dataType.names
    out = []
    for c in columns:
        base = F.col(f"b.{c}")
        new = F.col(f"d.{c}") if c in have else defaults.get(c, F.lit(None))
        value = F.when(F.col("action") == "insert", new)
        if c in updated:
            value = value.when(F.col("action") == "update", F.col(f"d.{c}"))
        if c in touched:
            value = value.when(F.col("action") == "touch", F.col(f"d.{c}"))
        out.append(value.otherwise(base).alias(c))
    return joined.select(*out, "action")


def action_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def with_ids(inserts: DataFrame, first: int, order: list[str], column: str = "id", per_part: int = 100_000) -> DataFrame:
    """Consecutive ids from first for new rows, in hashed parts that are numbered apart and put one after another."""
    parts = max(1, -(-inserts.count() // per_part))
    parted = inserts.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = parted.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_n", inside).join(before, "_part").withColumn(column, (F.col("_before") + F.col("_n") - 1 + first).cast("long")).drop("_part", "_n", "_before")


def children(base: DataFrame, delta: DataFrame, key: list[str], updated: list[str]) -> DataFrame:
    """Child rows after an upsert: delta rows, of which each key has one, win on updated columns; children that the delta lacks stay."""
    return merged(actions(base, delta, key), base.columns, updated)


class Ingest:
    """The stored events and occurrences after a collected batch, as if its rows were stored one by one in order of `pos`.

    batch: schemas.EVENT_CONTENT, source_item_key, detail_complete and pos (unique within a key; without one rows count as they come);
    children_: schemas.OCCURRENCE_CONTENT, source_occurrence_id, the event's source_item_key and pos (without one they belong to
    every row of the key), and `n` if an id may repeat within a row (the last counts). A row that breaks a rule, or one of whose
    occurrences does, fails whole. An incomplete row of an event that is there only marks it as seen, whether it breaks a rule or
    not; so does a failed one. All other rows are stored, over content and tracking columns, never curated ones. So of a key's
    rows the last valid complete one gives the content, or else, for a new event, the first valid one; occurrences are those of all rows that
    were stored, the last of each id, beside the ones that were there. New rows get ids above the greatest.

    A key's rows are never ordered: the first valid and the last valid complete position come from one aggregate, which combines before
    the shuffle; wide rows are joined once, to the positions chosen. Everything is computed when first asked for.
    """

    def __init__(
        self, events: DataFrame, occurrences: DataFrame, batch: DataFrame, children_: DataFrame, source_id: int, run_id: int | None, seen_at: Column,
        event_rules: dict[str, Column], child_rules: dict[str, Column],
    ):
        self.stored, self.stored_children = events, occurrences
        self.batch = batch if "pos" in batch.columns else staged(batch.withColumn("pos", F.monotonically_increasing_id()))
        self.children = children_ if "pos" in children_.columns else children_.join(self.batch.select("source_item_key", "pos"), "source_item_key")
        self.source_id, self.run_id, self.seen_at = source_id, run_id, seen_at
        self.event_rules, self.child_rules = event_rules, child_rules

    @cached_property
    def _checked(self) -> DataFrame:
        """key, pos, complete and the rules that a row and its occurrences break."""
        from .quality import violations

        of_children = self.children.select("source_item_key", "pos", F.explode(violations(self.child_rules)).alias("rule"))
        of_children = of_children.groupBy("source_item_key", "pos").agg(F.array_sort(F.collect_set("rule")).alias("_more"))
        own = self.batch.select("source_item_key", "pos", F.coalesce("detail_complete", F.lit(False)).alias("complete"), violations(self.event_rules).alias("violations"))
        joined = own.join(of_children, ["source_item_key", "pos"], "left")
        return staged(joined.withColumn("violations", F.concat("violations", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more"))

    @cached_property
    def _keys(self) -> DataFrame:
        """A row per key: the stored event's id, first_valid, and the position whose content is stored (null: none)."""
        valid = F.size("violations") == 0
        per_key = self._checked.where("source_item_key IS NOT NULL").groupBy("source_item_key").agg(
            F.min(F.when(valid, F.col("pos"))).alias("first_valid"), F.max(F.when(valid & F.col("complete"), F.col("pos"))).alias("last_complete")
        )
        there = self.stored.where(F.col("source_id") == self.source_id).select("source_item_key", F.col("id").alias("old_id"))
        joined = per_key.join(there, "source_item_key", "left")
        chosen = F.coalesce("last_complete", F.when(F.col("old_id").isNull(), F.col("first_valid")))
        return staged(joined.select("source_item_key", "old_id", "first_valid", chosen.alias("chosen")))

    @cached_property
    def _ids(self) -> DataFrame:
        """_keys with event_id: the old one, or the next for new events; null where nothing is stored."""
        new = self._keys.where("old_id IS NULL AND chosen IS NOT NULL").select("source_item_key")
        first = (self.stored.agg(F.max("id")).first()[0] or 0) + 1
        return self._keys.join(with_ids(new, first, ["source_item_key"], "_new"), "source_item_key", "left").withColumn("event_id", F.coalesce("old_id", "_new")).drop("_new")

    @property
    def outcomes(self) -> DataFrame:
        """source_item_key, pos, outcome (inserted, updated, touched or failed) and violations of each row of the batch."""
        r = self._checked.join(self._keys, "source_item_key", "left")
        valid, later = F.size("violations") == 0, F.col("old_id").isNotNull() | F.coalesce(F.col("pos") > F.col("first_valid"), F.lit(False))
        outcome = F.when(~F.col("complete") & later, "touched").when(~valid, "failed").when(later, "updated").otherwise("inserted")
        return r.select("source_item_key", "pos", outcome.alias("outcome"), "violations")

    @property
    def rejected(self) -> DataFrame:
        """source_item_key, pos and violations of each row that failed, the event's own rules first."""
        return self.outcomes.where("outcome = 'failed'").drop("outcome")

    @property
    def _given(self) -> DataFrame:
        """Occurrences of all rows that are stored, with their row's position and event_id."""
        kept = self.outcomes.where("outcome IN ('inserted', 'updated')").select("source_item_key", "pos")
        return self.children.join(kept, ["source_item_key", "pos"]).join(self._ids.select("source_item_key", "event_id"), "source_item_key")

    @property
    def events(self) -> DataFrame:
        """The events afterwards, with action: insert, update, touch or keep."""
        tracking = [c for c in schemas.EVENT_TRACKING if c != "content_hash"]
        pick = self._keys.where("chosen IS NOT NULL").select("source_item_key", F.col("chosen").alias("pos"))
        rows = self.batch.join(pick, ["source_item_key", "pos"])
        fresh = hashing.event_hash(rows, self.children.join(pick, ["source_item_key", "pos"]).drop("pos")).select("source_item_key", *schemas.EVENT_CONTENT, "content_hash")
        seen = {"collected_at": self.seen_at, "updated_at": self.seen_at, "last_verified_at": self.seen_at, "last_seen_at": self.seen_at, "last_seen_run_id": F.lit(self.run_id).cast("long"), "is_active": F.lit(True)}
        known = self._ids.where("event_id IS NOT NULL").select("source_item_key", F.col("event_id").alias("id"), F.col("chosen").isNotNull().alias("_chosen"))
        delta = known.join(fresh, "source_item_key", "left").withColumns({**seen, "source_id": F.lit(self.source_id).cast("long")})
        joined = actions(self.stored, delta, ["source_id", "source_item_key"], F.col("d._chosen"))
        return merged(joined, self.stored.columns, [*schemas.EVENT_CONTENT, *tracking, "content_hash"], ["last_seen_at", "last_seen_run_id", "is_active", "updated_at"])

    @property
    def occurrences(self) -> DataFrame:
        """The occurrences afterwards, with action: insert, update or keep."""
        content = [c for c in schemas.OCCURRENCE_CONTENT if c in self.children.columns and c not in ("collected_at", "updated_at")]
        order = F.struct("pos", "n") if "n" in self.children.columns else F.col("pos")
        last = self._given.groupBy("event_id", "source_occurrence_id").agg(F.max_by(F.struct(*content), order).alias("_o"))
        given = last.select("event_id", "source_occurrence_id", *(F.col("_o")[c].alias(c) for c in content)).withColumns({"collected_at": self.seen_at, "updated_at": self.seen_at})
        key = ["event_id", "source_occurrence_id"]
        new = staged(given.select(*key).join(self.stored_children.select(*key), key, "left_anti"))
        first = (self.stored_children.agg(F.max("id")).first()[0] or 0) + 1
        return children(self.stored_children, given.join(with_ids(new, first, key), key, "left"), key, list(schemas.OCCURRENCE_CONTENT))

    @property
    def counts(self) -> DataFrame:
        """One row: fetched, persisted, events inserted and updated (a touch is an update), occurrences inserted and updated, failed.

        An occurrence is inserted by the first row that brings it, if it wasn't there; every other time it is updated.
        """
        of = lambda *names: F.count_if(F.col("outcome").isin(*names))
        rows = self.outcomes.agg(
            F.count(F.lit(1)).alias("fetched"), of("inserted", "updated", "touched").alias("persisted"), of("inserted").alias("events_inserted"), of("updated", "touched").alias("events_updated"), of("failed").alias("failed")
        )
        times = self._given.groupBy("event_id", "source_occurrence_id", "pos").agg(F.count(F.lit(1)).alias("_n"))
        each = times.groupBy("event_id", "source_occurrence_id").agg(F.sum("_n").alias("_all"), F.min_by("_n", "pos").alias("_first"))
        was = self.stored_children.select("event_id", "source_occurrence_id", F.lit(True).alias("_was"))
        new = F.when(F.col("_was").isNull(), F.col("_first")).otherwise(0)
        lines = each.join(was, ["event_id", "source_occurrence_id"], "left").agg(F.coalesce(F.sum(new), F.lit(0)).alias("occurrences_inserted"), F.coalesce(F.sum(F.col("_all") - new), F.lit(0)).alias("occurrences_updated"))
        return rows.withColumn("_", F.lit(0)).join(lines.withColumn("_", F.lit(0)), "_").drop("_")


def ingest(
    events: DataFrame, occurrences: DataFrame, batch: DataFrame, children_: DataFrame, source_id: int, run_id: int | None, seen_at: Column,
    event_rules: dict[str, Column], child_rules: dict[str, Column],
) -> Ingest:
    """A batch replayed onto the stored tables; see Ingest for what it gives."""
    return Ingest(events, occurrences, batch, children_, source_id, run_id, seen_at, event_rules, child_rules)


def _numbered(after: DataFrame, before: DataFrame, order: list[str]) -> DataFrame:
    """Gives inserted rows ids above the greatest there was."""
    first = (before.agg(F.max("id")).first()[0] or 0) + 1
    new = with_ids(after.where("action = 'insert'").drop("id"), first, order)
    return after.where("action <> 'insert'").unionByName(new)


def upsert_source(sources: DataFrame, given: DataFrame, at: Column) -> DataFrame:
    """Sources after given(name, base_url, source_type): known names get the address, the kind and is_active anew and keep id and
    counters; new ones get the next ids, active and without errors."""
    delta = given.select("name", "base_url", "source_type").withColumns({"is_active": F.lit(True), "updated_at": at})
    fresh = {"error_count": F.lit(0), "created_at": at}
    after = merged(actions(sources, delta, ["name"]), sources.columns, ["base_url", "source_type", "is_active", "updated_at"], defaults=fresh)
    return _numbered(after, sources, ["name"]).drop("action")


def touch(events: DataFrame, keys: DataFrame, key: list[str], run_id: int | None, seen_at: Column) -> DataFrame:
    """Marks existing rows as seen: four tracking columns change, content does not."""
    seen = events.join(keys.select(*key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    hit = F.coalesce("_seen", F.lit(False))
    changes = {"last_seen_at": seen_at, "last_seen_run_id": F.lit(run_id).cast("long"), "is_active": F.lit(True), "updated_at": seen_at}
    return seen.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in events.columns))
