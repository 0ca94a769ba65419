"""The registered queries: every operator applied to whole tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import hashing, period, strict, text, url
from ..operators import derive, merge, normalize, quality, runs, serve
from ..sources import html, landing, slots
from ..sources.store import staged

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Reads


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.when(status == "F", False).when(status == "O", True).when(F.col("o_orderkey") % 2 == 0, True).alias("is_active"), F.when(status != "P", F.col("o_orderdate")).alias("start_at"), "o_totalprice")


_LISTED = """listed AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN FALSE WHEN o_orderstatus = 'O' THEN TRUE WHEN o_orderkey % 2 = 0 THEN TRUE END AS is_active,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS start_at, o_totalprice FROM orders)"""


@register(f"WITH {_LISTED} SELECT o_orderkey, start_at, o_totalprice FROM listed WHERE is_active IS TRUE ORDER BY start_at ASC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def active_page(spark, sf_dir):
    return serve.page(serve.active(_listed(spark, sf_dir)), "start_at", "o_orderkey", 20, 40).select("o_orderkey", "start_at", "o_totalprice")


@register(f"""WITH {_LISTED} SELECT o_orderkey, start_at, o_totalprice FROM listed WHERE is_active IS TRUE
  QUALIFY row_number() OVER (ORDER BY start_at ASC NULLS LAST, o_orderkey) - 1 - 9 * count(*) OVER () // 10 BETWEEN 0 AND 19""")
def deep_page(spark, sf_dir):
    index = serve.RankIndex(serve.active(_listed(spark, sf_dir)), "start_at", "o_orderkey", 2000)
    return index.page(20, 9 * index.total // 10).select("o_orderkey", "start_at", "o_totalprice")


@register(f"WITH {_LISTED} SELECT count(o_orderkey) AS total FROM listed WHERE is_active IS TRUE")
def active_count(spark, sf_dir):
    return serve.active(_listed(spark, sf_dir)).agg(F.count("o_orderkey").alias("total"))


@register("""WITH firsts AS (SELECT event_type, min(event_id) AS f FROM events GROUP BY event_type),
  ahead AS (SELECT * FROM firsts ORDER BY f LIMIT 3)
  SELECT e.event_id, e.event_type FROM events e LEFT JOIN ahead l ON e.event_type = l.event_type AND e.event_id = l.f ORDER BY l.f IS NULL, e.event_id LIMIT 3""")
def representative_samples(spark, sf_dir):
    return serve.representatives(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@register("""SELECT o_orderkey, o_orderstatus, coalesce(lines, '') AS lines, coalesce(n, 0) AS n FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey
) ON o_orderkey = l_orderkey""")
def nested_children(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = serve.nested_children(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["l_linenumber", "l_partkey"])
    shown = F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return nested.select("o_orderkey", "o_orderstatus", shown.alias("lines"), F.size("children").alias("n"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 9 HOUR, '%Y. %-m. %-d. %H:%M') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y. %-m. %-d.') ELSE '일정 미정' END AS shown, CASE WHEN o_custkey % 4 > 0 THEN o_orderpriority ELSE '주최 기관 미정' END AS organizer FROM orders""")
def card_dates(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    at, day = F.when(k == 0, F.col("o_orderdate").cast("timestamp")), F.when(k <= 1, F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", serve.shown_date(at, day).alias("shown"), serve.shown_organizer(F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderpriority"))).alias("organizer"))


# Merges


def _base(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.lit(1).alias("seen_run"))


def _delta(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return o.select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"), F.lit(2).alias("seen_run"), (F.col("o_orderkey") % 2 == 0).alias("complete"))


_BASE = "b AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, 1 AS seen_run FROM orders WHERE o_orderkey % 10 <> 0)"
_DELTA = "d AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'N' AS o_orderstatus, 2 AS seen_run, o_orderkey % 2 = 0 AS complete FROM orders WHERE o_orderkey % 3 = 0)"
_MERGED = f"""WITH {_BASE}, {_DELTA}, m AS (
  SELECT coalesce(b.o_orderkey, d.o_orderkey) AS o_orderkey, coalesce(d.o_totalprice, b.o_totalprice) AS o_totalprice,
    coalesce(d.o_orderstatus, b.o_orderstatus) AS o_orderstatus, b.o_orderpriority, coalesce(d.seen_run, b.seen_run) AS seen_run,
    CASE WHEN d.o_orderkey IS NULL THEN 'keep' WHEN b.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS action
  FROM b FULL JOIN d ON b.o_orderkey = d.o_orderkey)"""
_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "seen_run"]


def _merged(spark, sf_dir):
    joined = merge.actions(_base(spark, sf_dir), _delta(spark, sf_dir), ["o_orderkey"])
    return merge.merged(joined, _COLUMNS, ["o_totalprice", "o_orderstatus", "seen_run"])


@register(f"{_MERGED} SELECT * FROM m")
def upsert_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@register(f"{_MERGED} SELECT action, count(*) AS n FROM m GROUP BY action")
def merge_counts(spark, sf_dir):
    return merge.action_counts(_merged(spark, sf_dir))


@register(f"""WITH {_BASE}, {_DELTA} SELECT coalesce(b.o_orderkey, d.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NULL OR d.complete THEN d.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
  CASE WHEN b.o_orderkey IS NULL OR d.complete THEN d.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus, b.o_orderpriority, coalesce(d.seen_run, b.seen_run) AS seen_run,
  CASE WHEN d.o_orderkey IS NULL THEN 'keep' WHEN b.o_orderkey IS NULL THEN 'insert' WHEN d.complete THEN 'update' ELSE 'touch' END AS action
  FROM b FULL JOIN d ON b.o_orderkey = d.o_orderkey""")
def incomplete_touch(spark, sf_dir):
    joined = merge.actions(_base(spark, sf_dir), _delta(spark, sf_dir), ["o_orderkey"], F.col("d.complete"))
    return merge.merged(joined, _COLUMNS, ["o_totalprice", "o_orderstatus", "seen_run"], ["seen_run"])


@register("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL),
  b AS (SELECT * FROM l WHERE l_linenumber <> 3), d AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity FROM l WHERE l_orderkey % 4 = 0)
  SELECT coalesce(b.l_orderkey, d.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, d.l_linenumber) AS l_linenumber, coalesce(d.l_quantity, b.l_quantity) AS l_quantity,
    CASE WHEN d.l_orderkey IS NULL THEN 'keep' WHEN b.l_orderkey IS NULL THEN 'insert' ELSE 'update' END AS action
  FROM b FULL JOIN d ON b.l_orderkey = d.l_orderkey AND b.l_linenumber = d.l_linenumber""")
def child_upsert(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    delta = lines.where("l_orderkey % 4 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    return merge.children(lines.where("l_linenumber <> 3"), delta, ["l_orderkey", "l_linenumber"], ["l_quantity"])


@register("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_last_wins(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return merge.last_wins(e, ["user_id"], "at").select("user_id", "event_id", "event_type", "value")


@register("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (value > 50) IS NOT TRUE,
  CASE WHEN value > 50 THEN -event_id ELSE event_id END) AS n FROM events) WHERE n = 1""")
def dedupe_complete_wins(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("complete", F.col("value") > 50)
    return merge.last_wins(e.withColumn("at", F.col("event_id")), ["user_id"], "at", "complete").select("user_id", "event_id", "event_type")


_PARTS = """p AS (SELECT p_partkey, p_brand AS source_code, p_size > 5 AS is_active, CASE WHEN k IS NOT NULL THEN 7 WHEN p_partkey % 2 = 0 THEN 6 END AS last_seen_run_id
  FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) ON p_partkey = k)"""


@register(f"""WITH {_PARTS} SELECT p_partkey, source_code, is_active AND NOT (source_code IN ('Brand#11', 'Brand#12', 'Brand#13') AND last_seen_run_id IS DISTINCT FROM 7) AS is_active FROM p""")
def stale_deactivate(spark, sf_dir):
    seen = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("seen")).distinct()
    parts = _t(spark, sf_dir, "part").join(seen, "p_partkey", "left").select(
        "p_partkey", F.col("p_brand").alias("source_code"), (F.col("p_size") > 5).alias("is_active"), F.when(F.col("seen"), 7).when(F.col("p_partkey") % 2 == 0, 6).alias("last_seen_run_id")
    )
    stale = runs.unseen(7, ["Brand#11", "Brand#12", "Brand#13"])
    return parts.select("p_partkey", "source_code", F.when(stale, False).otherwise(F.col("is_active")).alias("is_active"))


# Keys, digests, URLs


@register("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'LEC_' || page_id ELSE 'urlsha256:' || sha256(url) END AS item_key FROM pages")
def item_key(spark, sf_dir):
    known = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("LEC_"), F.col("page_id").cast("string")))
    return _t(spark, sf_dir, "pages").select("page_id", url.item_key(known, F.col("url")).alias("item_key"))


@register("""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), ';jsessionid=[^/?#&;]*', '', 'i') AS canonical,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', '') AS host FROM pages""")
def url_canonical(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("canonical"), url.host(F.col("url")).alias("host"))


@register("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'EXP' ELSE 'external' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'EXP_' || page_id END AS resource_id,
  CASE WHEN page_id % 2 = 0 THEN 'F4' || page_id WHEN page_id % 3 = 0 THEN 'F401' ELSE 'F601' END AS menu FROM pages""")
def resource_ids(spark, sf_dir):
    n = F.col("page_id")
    ids = F.when(n % 3 == 0, F.concat(F.lit("rsrcUnqId=EXP_"), n.cast("string"))).when(n % 3 == 1, F.lit("rsrcUnqId=EXP_1&rsrcUnqId=EXP_2")).otherwise(F.lit("rsrcUnqId=OTHER_1"))
    whole = F.concat(F.lit("https://Site.Example.net/view?"), ids, F.when(n % 2 == 0, F.concat(F.lit("&mnu_code=F4"), n.cast("string"))).otherwise(""))
    kind, found = url.resource(whole, ("site.example.net",))
    return _t(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), found.alias("resource_id"), url.menu_code(whole, kind).alias("menu"))


@register("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00","o_orderpriority":"' || o_orderpriority
  || '","o_orderstatus":"' || o_orderstatus || '","o_price":"' || regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR), '\\.?0+$', '') || '","unknown":null}') AS content_hash FROM orders""")
def content_hash(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderpriority", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_price"), F.lit(None).cast("string").alias("unknown"),
    )
    return o.select("o_orderkey", hashing.content_hash(o, [c for c in o.columns if c != "o_orderkey"]).alias("content_hash"))


# JSON


def _props(spark, sf_dir):
    payload = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return _t(spark, sf_dir, "events").select("event_id", "user_id", payload.alias("payload"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@register(f"""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 0 END AS pos, CASE WHEN event_id % 7 <> 0 THEN {_K} END AS k,
  CASE WHEN event_id % 7 = 0 THEN 'payload is not a JSON array' END AS error FROM events""")
def json_slots(spark, sf_dir):
    r = slots.rows(_props(spark, sf_dir)).withColumn("k", strict.nonnegative_int(F.try_variant_get("row", "$.k", "variant"), "k"))
    return r.select("event_id", "pos", F.col("k.value").alias("k"), F.coalesce("error", "k.error").alias("error"))


@register(f"""SELECT event_id, CASE WHEN user_id % 50 <= {_K} THEN {_K} - user_id % 50 END AS available,
  CASE WHEN user_id % 50 > {_K} THEN 'reserved exceeds capacity' END AS error FROM events WHERE event_id % 7 <> 0""")
def available(spark, sf_dir):
    k = strict.nonnegative_int(F.try_variant_get("row", "$.k", "variant"), "k")["value"]
    left = slots.rows(_props(spark, sf_dir)).where("error is null").withColumn("left", strict.available(k, F.col("user_id") % 50))
    return left.select("event_id", F.col("left.value").alias("available"), F.col("left.error").alias("error"))


# Texts


@register(r"SELECT doc_id, md5(collapsed) AS collapsed_md5 FROM (SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '[^\S\n]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '') AS collapsed FROM documents)")
def text_collapse(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapsed(F.col("text"))).alias("collapsed_md5"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@register(f"SELECT doc_id, md5(nullif(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)), '')) AS lines_md5 FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def line_dedupe(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.unique_lines(F.col("text"))).alias("lines_md5"))


@register(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, '.')) AS x, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents),
  p AS (SELECT doc_id, i, regexp_replace(split_part(x, ',', 1), '^\s+|\s+$', '', 'g') AS label, regexp_replace(substr(x, strpos(x, ',') + 1), '^\s+|\s+$', '', 'g') AS value FROM l WHERE strpos(x, ',') > 0)
  SELECT doc_id, label, value FROM p WHERE label <> '' AND value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY i DESC) = 1""")
def label_values(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(text.label_values(F.split("text", r"\."), ",")).alias("label", "value"))


_SECTIONS = r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
  x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
  h AS (SELECT *, starts_with(line, 'The') AS heading FROM x),
  o AS (SELECT *, last_value(CASE WHEN heading THEN contains(line, 'and') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS open FROM h),
  k AS (SELECT doc_id, i, regexp_replace(line, '\s+', ' ', 'g') AS line FROM o WHERE coalesce(open, FALSE) OR (NOT heading AND contains(line, 'that'))),
  f AS (SELECT doc_id, line, min(i) AS i FROM k GROUP BY ALL)
  SELECT doc_id, md5(g.t) AS lines_md5 FROM documents LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM f GROUP BY doc_id) g USING (doc_id)"""


@register(_SECTIONS)
def target_lines(spark, sf_dir):
    found = text.target_lines(F.col("text"), words=("that",), headings=("and",), section="The", bullets="")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(found).alias("lines_md5"))


@register("SELECT doc_id, contains(lower(text), 'licensed under') OR contains(lower(text), 'access denied') AS blocked FROM documents")
def block_page_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.is_block_page(F.col("text"), ("licensed under", "access denied")).alias("blocked"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS INTEGER) END AS n,
  CASE WHEN l_linenumber % 3 = 0 THEN TRUE WHEN l_linenumber % 3 = 1 THEN FALSE END AS is_free FROM lineitem""")
def numeric_texts(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    number, fee = F.concat(F.lit(" "), q, F.when(n % 2 == 0, "명").otherwise("")), F.when(n % 3 == 0, "무 료").when(n % 3 == 1, "유료").otherwise("1,000원")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.plain_integer(number).alias("n"), text.free_value(fee).alias("is_free"))


# Periods

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@register(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN {_DAY} END AS start_day, CASE WHEN o_orderkey % 5 > 1 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') END AS end_day,
  CASE WHEN o_orderkey % 5 = 1 THEN 'invalid date' END AS error FROM orders""")
def date_range(spark, sf_dir):
    k, day = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(k == 0, "상시 접수").when(k == 1, "2026-13-40 ~ 2026-12-01").otherwise(F.concat(F.lit("기간 "), day, F.lit(" ~ "), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 9), "yyyy-MM-dd")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", period.date_range(value).alias("r")).select("o_orderkey", F.col("r.start").cast("string").alias("start_day"), F.col("r.end").cast("string").alias("end_day"), "r.error")


@register(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN strftime(CAST({_DAY} || ' 10:30:00' AS TIMESTAMP) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') END AS start_utc,
  CASE WHEN o_orderkey % 4 <= 1 THEN {_DAY} END AS start_date, CASE WHEN o_orderkey % 4 = 1 THEN 'end precedes start' END AS error FROM orders""")
def period_precision(spark, sf_dir):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(k > 1, F.concat(day, F.lit(" 10:30 ~ "), day, F.lit(" 12:00"))).when(k == 1, F.concat(day, F.lit(" 12:00 ~ "), day, F.lit(" 10:30")))
    r = _t(spark, sf_dir, "orders").withColumn("r", period.datetime_range(value))
    start = period.date_unless_known(F.col("r.start"), F.col("o_orderdate").cast("date"))
    return r.select("o_orderkey", F.date_format("r.start", "yyyy-MM-dd HH:mm:ss").alias("start_utc"), start.cast("string").alias("start_date"), "r.error")


# Quality, counts and runs


@register("""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN NOT (l_discount <= 0.05) THEN 'discount' END, CASE WHEN NOT (l_quantity >= 5) THEN 'quantity' END,
  CASE WHEN NOT (CASE WHEN l_returnflag <> 'N' THEN l_tax < 0.04 END) THEN 'tax' END], lambda x: x IS NOT NULL), ',') AS violations FROM lineitem) WHERE violations <> ''""")
def quality_violations(spark, sf_dir):
    rules = {"discount": F.col("l_discount") <= 0.05, "quantity": F.col("l_quantity") >= 5, "tax": F.when(F.col("l_returnflag") != "N", F.col("l_tax") < 0.04)}
    _, rejected = quality.split(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity", "l_returnflag", "l_tax"), rules)
    return rejected.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("violations", ",").alias("violations"))


@register("SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return quality.duplicates(_t(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


@register("""SELECT count(*) AS items, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) - count(*) FILTER (event_type = 'view') AS internal, count(*) FILTER (value IS NULL OR value < 10) AS low FROM events""")
def kind_counts(spark, sf_dir):
    kinds = [F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view", "purchase")]
    low = F.count_if(F.col("value").isNull() | (F.col("value") < 10)).alias("low")
    return _t(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("items"), *kinds, (F.count(F.lit(1)) - F.count_if(F.col("event_type") == "view")).alias("internal"), low)


def _pages(spark, sf_dir):
    """List pages of runs, some with faults: a page that never landed, fails, is short, skips a page, leads back or shows no pagination."""
    e = _t(spark, sf_dir, "events").select("user_id", F.expr("event_id div 120").alias("run"), (F.expr("event_id div 12") % 10 + 1).alias("page"))
    p, s, n = e.groupBy("run", "page").agg(F.sum("user_id").alias("s")), F.col("s"), F.col("page")
    return p.where("s % 37 <> 0").select(
        "run", "page", F.when((s % 41 == 0) | ((n == 10) & (s % 2 == 0)), 9).otherwise(12).alias("list_count"), (s % 43 != 0).alias("succeeded"),
        F.when(s % 47 == 0, n + 2).when(s % 53 == 0, 1).when((n < 10) | (s % 5 == 0), n + 1).alias("next_page"), (s % 59 != 0).alias("pagination_detected"),
        F.when(s % 61 == 0, 1).otherwise(0).alias("detail_failures"), F.when(s % 67 == 0, 1).otherwise(0).alias("error_count"),
    )


_CHAIN = """p AS (SELECT run, page, CASE WHEN s % 41 = 0 OR (page = 10 AND s % 2 = 0) THEN 9 ELSE 12 END AS list_count, s % 43 <> 0 AS good,
    CASE WHEN s % 47 = 0 THEN page + 2 WHEN s % 53 = 0 THEN 1 WHEN page < 10 OR s % 5 = 0 THEN page + 1 END AS next_page, s % 59 <> 0 AS detected, s % 61 = 0 AS detail_bad, s % 67 = 0 AS bad FROM (
    SELECT event_id // 120 AS run, event_id // 12 % 10 + 1 AS page, CAST(sum(user_id) AS BIGINT) AS s FROM events GROUP BY 1, 2) WHERE s % 37 <> 0),
  f AS (SELECT *, coalesce(next_page > page + 1, FALSE) AS skips, good AND NOT coalesce(next_page > page + 1, FALSE) AS succeeded FROM p),
  g AS (SELECT *, CASE WHEN succeeded AND list_count >= 12 AND detected THEN next_page END AS follows FROM f),
  w AS (SELECT run, page, 0 AS step FROM g WHERE page = 1 UNION ALL SELECT g.run, h.page, w.step + 1 FROM w JOIN g ON g.run = w.run AND g.page = w.page JOIN g h ON h.run = g.run AND h.page = g.follows WHERE w.step < 20),
  c AS (SELECT g.*, m.step FROM g LEFT JOIN (SELECT run, page, CAST(min(step) AS BIGINT) AS step FROM w GROUP BY ALL) m USING (run, page))"""
_RUNS = f"""{_CHAIN},
  l AS (SELECT run, page AS last_page, list_count, succeeded AS last_ok, next_page, detected, follows, step FROM c WHERE step < 10 QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1),
  a AS (SELECT run, count(*) AS attempted, count(*) FILTER (succeeded) AS succeeded_n, count(*) FILTER (step < 10) AS followed, CAST(sum(list_count) AS BIGINT) AS items_seen, count(*) FILTER (detail_bad) AS details,
    count(*) FILTER (bad OR skips) AS errors FROM c GROUP BY run),
  r AS (SELECT *, CASE WHEN last_page IS NULL THEN 1 WHEN step < 9 AND follows > last_page THEN follows END AS missing_page, coalesce(step < 9 AND follows <= last_page, FALSE) AS loops FROM a LEFT JOIN l USING (run)),
  t AS (SELECT *, CASE WHEN missing_page IS NOT NULL THEN 'page-missing' WHEN loops THEN 'page-loop' WHEN list_count < 12 AND next_page IS NOT NULL AND last_ok THEN 'pagination-conflict'
    WHEN last_ok AND list_count = 12 AND NOT detected THEN 'pagination-missing' WHEN step = 9 AND next_page IS NOT NULL THEN 'max-pages' WHEN NOT last_ok THEN 'page-failure' WHEN list_count < 12 THEN 'short-page' ELSE 'last-page' END AS stop_reason FROM r),
  d AS (SELECT run, count(*) AS repeated FROM (SELECT event_id // 120 AS run FROM events WHERE event_id % 113 = 0 OR event_id % 119 = 0 GROUP BY event_id // 120, CASE WHEN event_id % 113 = 0 THEN 113 ELSE 119 END HAVING count(*) > 1) GROUP BY 1),
  v AS (SELECT *, coalesce(stop_reason IN ('short-page', 'last-page') AND last_ok AND next_page IS NULL AND succeeded_n = attempted AND followed = attempted AND errors = 0 AND details = 0 AND repeated IS NULL, FALSE) AS is_complete FROM t LEFT JOIN d USING (run))"""


@register(f"WITH RECURSIVE {_CHAIN} SELECT run, page, step, follows, succeeded FROM c")
def page_chain(spark, sf_dir):
    return runs.followed(_pages(spark, sf_dir), ["run"], 12).select("run", "page", "step", "follows", "succeeded")


def _verdicts(spark, sf_dir):
    k = F.col("event_id")
    keys = _t(spark, sf_dir, "events").select(F.expr("event_id div 120").alias("run"), F.when(k % 113 == 0, "a").when(k % 119 == 0, "b").otherwise(k.cast("string")).alias("source_item_key"))
    return runs.verdict(runs.chains(_pages(spark, sf_dir), ["run"], 12, 10), 12, runs.repeated_keys(keys, ["run"]))


@register(f"WITH RECURSIVE {_RUNS} SELECT run, attempted AS pages_attempted, succeeded_n AS pages_succeeded, followed AS pages_followed, missing_page, loops, items_seen, stop_reason FROM v")
def stop_reason(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("run", "pages_attempted", "pages_succeeded", "pages_followed", "missing_page", "loops", "items_seen", "stop_reason")


@register(f"WITH RECURSIVE {_RUNS} SELECT run, is_complete AS is_complete_snapshot, coalesce(repeated, 0) AS repeated_keys, CASE WHEN is_complete THEN 'success' WHEN succeeded_n > 0 THEN 'partial' ELSE 'failed' END AS status FROM v")
def run_status(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("run", "is_complete_snapshot", "repeated_keys", "status")


@register("""SELECT event_id // 12 AS page, count(*) AS items, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(user_id) AS BIGINT) AS users,
  substr(string_agg(CASE WHEN event_type = 'error' THEN 'page ' || (event_id // 12) || ': ' || event_id END, ' | ' ORDER BY event_id), 1, 10000) AS message FROM events GROUP BY 1""")
def page_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("page", F.expr("event_id div 12"))
    e = e.withColumn("issue", F.when(F.col("event_type") == "error", text.issue(F.lit("page"), F.col("page").cast("string"), F.col("event_id").cast("string"))))
    counts = e.groupBy("page").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum("user_id").alias("users"))
    return counts.join(runs.first_messages(e, ["page"], "event_id", "issue"), "page", "left")


@register("""SELECT event_id, user_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS error_count FROM (
  SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)""")
def failure_streak(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return runs.failure_streaks(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "error_count")


@register("""SELECT event_id, CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'partial' ELSE 'success' END = 'success' AND user_id % 3 <> 0 AND value IS NOT NULL AND user_id % 5 < 4 AS allowed,
  CASE user_id % 5 WHEN 0 THEN 'F300' WHEN 1 THEN 'F400' WHEN 2 THEN 'F300,F400' WHEN 3 THEN 'F300,F400' ELSE '' END AS codes FROM events""")
def scope_gate(spark, sf_dir):
    scope = F.element_at(F.array(*map(F.lit, ("F300", "F400", "F300:F400", "full", "F300:page-1-test"))), (F.col("user_id") % 5 + 1).cast("int"))
    r = _t(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "partial").otherwise("success").alias("status"), (F.col("user_id") % 3 != 0).alias("is_complete_snapshot"),
        F.when(F.col("value").isNotNull(), F.col("ts")).alias("finished_at"), scope.alias("scope"),
    )
    return r.select("event_id", runs.may_deactivate().alias("allowed"), F.array_join(runs.scope_codes(F.col("scope")), ",").alias("codes"))


@register("SELECT coalesce(event_type, 'total') AS endpoint, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def request_counts(spark, sf_dir):
    return landing.request_counts(_t(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint")))


@register("""SELECT endpoint, a - b AS delta FROM (SELECT event_type || ':' || user_id % 100 AS endpoint, count(*) FILTER (event_id % 2 = 0) AS b, count(*) FILTER (event_id % 3 = 0) AS a FROM events GROUP BY 1) WHERE greatest(a, b) > 0""")
def request_delta(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 100).cast("string")).alias("endpoint"))
    before, after = (e.where(f"event_id % {k} = 0").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n")) for k in (2, 3))
    return landing.count_delta(before, after)


@register("""SELECT event_id, CASE WHEN s IN (408, 425, 429, 500, 502, 503, 504) THEN 'retry' WHEN s < 200 OR s >= 300 THEN 'error' WHEN event_id % 9 = 0 THEN 'empty' WHEN event_id % 7 = 0 THEN 'malformed' ELSE 'ok' END AS outcome
  FROM (SELECT event_id, 200 + user_id % 310 AS s FROM events)""")
def response_classes(spark, sf_dir):
    body = F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("payload"))
    return _props(spark, sf_dir).select("event_id", landing.classify(200 + F.col("user_id") % 310, body, F.lit(True)).alias("outcome"))


@register("""SELECT event_id, s IN (408, 425, 429, 500, 502, 503, 504) AND event_id % 4 < 2 AS again, CASE WHEN s IN (408, 425, 429, 500, 502, 503, 504) AND event_id % 4 < 2 THEN 0.5 * pow(2, event_id % 4) + (user_id % 10) / 40.0 END AS wait
  FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 503 WHEN user_id % 3 = 1 THEN 404 ELSE 200 END AS s FROM events)""")
def retries(spark, sf_dir):
    k, attempt = F.col("user_id") % 3, F.col("event_id") % 4
    outcome = landing.classify(F.when(k == 0, 503).when(k == 1, 404).otherwise(200), F.lit("x"))
    again = landing.asks_again(outcome, attempt)
    return _t(spark, sf_dir, "events").select("event_id", again.alias("again"), F.when(again, landing.backoff_seconds(attempt, share=F.col("user_id") % 10 / 10.0)).alias("wait"))


# HTML


@register("""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '[ \\t]+', ' ', 'g')), '') AS title FROM pages""")
def html_title(spark, sf_dir):
    return html.with_titles(_t(spark, sf_dir, "pages").select("page_id", "html"))


@register(r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(regexp_replace(href, '&quot;', '"', 'g'), '&amp;', '&', 'g') AS href FROM (
  SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]*)', 1) AS l FROM pages))""")
def html_links(spark, sf_dir):
    return html.with_links(_t(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "pos", "href")


_BOARD = """CASE WHEN page_id % 4 = 0 THEN '' ELSE '<ul class="img-board">' || CASE WHEN page_id % 4 = 1 THEN '' ELSE '<li><a href="' || replace(url, '&', '&amp;') || '"><h4 class="tit">' || page_id || '</h4></a></li>' ||
  CASE WHEN page_id % 8 = 2 THEN '<li><h4 class="tit">x</h4></li>' ELSE '' END END || '</ul>' END"""


@register(f"""WITH b AS (SELECT page_id, {_BOARD} AS board FROM pages), n AS (
  SELECT page_id, contains(board, 'img-board') AS has_board, len(regexp_extract_all(board, '<li>')) AS items, len(regexp_extract_all(board, '<li><a href="[^"]*"><h4 class="tit">[^<]+</h4>')) AS cards FROM b)
  SELECT page_id, CAST(cards AS INTEGER) AS list_count, has_board AND items > 0 AND items = cards AS succeeded,
    CASE WHEN NOT has_board THEN 'no card list' WHEN items = 0 THEN 'empty card list' WHEN cards < items THEN 'card ' || items || ' has no link' END AS error FROM n""")
def list_pages(spark, sf_dir):
    n = F.col("page_id")
    card = F.concat(F.lit('<li><a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"><h4 class="tit">'), n.cast("string"), F.lit("</h4></a></li>"))
    broken = F.when(n % 8 == 2, '<li><h4 class="tit">x</h4></li>').otherwise("")
    board = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit('<ul class="img-board">'), F.when(n % 4 == 1, "").otherwise(F.concat(card, broken)), F.lit("</ul>")))
    pages = _t(spark, sf_dir, "pages").select("page_id", F.lit(1).alias("page"), board.alias("html"))
    return html.page_rows(pages).select("page_id", "list_count", "succeeded", "error")


@register(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), ';jsessionid=[^/?#&;]*', '', 'i') AS u FROM pages WHERE url IS NOT NULL),
  k AS (SELECT page_id, 'urlsha256:' || sha256(u) AS source_item_key FROM c), s AS (SELECT DISTINCT source_item_key FROM k WHERE page_id % 3 = 0),
  v AS (SELECT source_item_key, max(page_id) FILTER (page_id % 5 > 0) AS good FROM k GROUP BY 1)
  SELECT v.source_item_key, CASE WHEN good IS NULL THEN 'old' ELSE 'p' || good END AS title, CASE WHEN good % 2 = 0 THEN '2026-03-01' END AS registration_day,
    CASE WHEN s.source_item_key IS NULL THEN 'insert' WHEN good IS NULL THEN 'touch' ELSE 'update' END AS action FROM v LEFT JOIN s ON v.source_item_key = s.source_item_key WHERE good IS NOT NULL OR s.source_item_key IS NOT NULL""")
def page_ingest(spark, sf_dir):
    """Landed list pages, whose cards lead to the urls of `pages`, read, normalized and stored; cards with an impossible date fail."""
    n = F.col("page_id")
    period_ = F.when(n % 5 == 0, "2026-13-40 ~ 2026-12-01").when(n % 2 == 0, "2026-03-01 ~ 2026-03-20").otherwise("상시")
    card = F.concat(
        F.lit('<ul class="img-board"><li><a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"><h4 class="tit">p'), n.cast("string"),
        F.lit('</h4></a><ul class="info"><li>접수기간: '), period_, F.lit("</li></ul></li></ul>"),
    )
    landed = _t(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", card.alias("html"))
    items = normalize.list_items(staged(html.with_cards(landed)), ("reserve.example.kr",), "https://reserve.example.kr/list")
    none = spark.createDataFrame([], "resource_id string, title string, organizer string, fields map<string,string>, description string, address string, active_dates array<string>")
    events = staged(normalize.events(items, normalize.details(none), "F300", keep=("page_id",)).withColumnRenamed("page_id", "pos"))
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.EVENTS).schema}
    old = events.where("pos % 3 = 0").select("source_item_key").distinct().withColumns({"source_id": F.lit(1).cast("long"), "title": F.lit("old"), "id": F.pmod(F.xxhash64("source_item_key"), F.lit(1 << 40))})
    old = old.select(*((F.col(c) if c in old.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    lines = {c: t for c, t in schemas.OCCURRENCE_CONTENT.items() if c not in ("collected_at", "updated_at")} | {"source_item_key": "string", "source_occurrence_id": "string", "pos": "long"}
    no_lines = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in lines.items()))
    rules = quality.event_rules() | {"parsed": F.col("parse_error").isNull()}
    at = F.lit("2026-08-01 00:00:00").cast("timestamp")
    stored = merge.ingest(old, spark.createDataFrame([], schemas.OCCURRENCES), events, no_lines, 1, 2, at, rules, quality.occurrence_rules())
    return stored.events.select("source_item_key", "title", F.col("registration_start_date").cast("string").alias("registration_day"), "action")


# Slots

_SLOT_JSON = """'[{{"oprtId":' || event_id || ',"stTm":"' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':15","enTm":"' || lpad(CAST((event_id + 1) % 24 AS VARCHAR), 2, '0') || ':00","aplyYn":"' ||
  CASE WHEN event_type = 'view' THEN 'Y' WHEN event_type = 'error' THEN 'X' ELSE 'N' END || '","{0}":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',"{1}":' || user_id % 50 || ',"fee":' ||
  CASE WHEN event_id % 3 = 0 THEN '"0"' WHEN event_id % 3 = 1 THEN 'null' ELSE '1500' END || '}}]'"""


def _slot_rows(spark, sf_dir, capacity: str, reserved: str) -> DataFrame:
    n, hour = F.col("event_id"), lambda c: F.lpad(c.cast("string"), 2, "0")
    kind = F.col("event_type")
    payload = F.concat(
        F.lit('[{"oprtId":'), n.cast("string"), F.lit(',"stTm":"'), hour(n % 24), F.lit(':15","enTm":"'), hour((n + 1) % 24), F.lit(':00","aplyYn":"'),
        F.when(kind == "view", "Y").when(kind == "error", "X").otherwise("N"), F.lit(f'","{capacity}":'), F.get_json_object("props", "$.k"), F.lit(f',"{reserved}":'),
        (F.col("user_id") % 50).cast("string"), F.lit(',"fee":'), F.when(n % 3 == 0, '"0"').when(n % 3 == 1, "null").otherwise("1500"), F.lit("}]"),
    )
    return _t(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("resource_id"), F.col("ts").cast("date").alias("day"), payload.alias("payload"))


def _slots(kind: str) -> str:
    capacity, reserved = slots.FIELDS[kind]
    name = "resource_id || ':' || day || ':' || " + ("json_extract_string(j, '$.oprtId')" if kind == "EXP" else "json_extract_string(j, '$.stTm') || ':' || json_extract_string(j, '$.enTm')")
    return f"""WITH j AS (SELECT CAST(event_id AS VARCHAR) AS resource_id, strftime(ts, '%Y-%m-%d') AS day, json_extract({_SLOT_JSON.format(capacity, reserved)}, '$[0]') AS j FROM events),
  v AS (SELECT *, CAST(json_extract_string(j, '$.{capacity}') AS BIGINT) AS capacity, CAST(json_extract_string(j, '$.{reserved}') AS BIGINT) AS reserved_count, json_extract_string(j, '$.aplyYn') AS yn,
    CAST(json_extract_string(j, '$.fee') AS DECIMAL(38, 9)) AS fee, CAST(day || ' ' || json_extract_string(j, '$.stTm') AS TIMESTAMP) AS s, CAST(day || ' ' || json_extract_string(j, '$.enTm') AS TIMESTAMP) AS e FROM j)
  SELECT resource_id, {name} AS source_occurrence_id, strftime(s - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS start_utc, strftime(e - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS end_utc, capacity, reserved_count,
    CASE WHEN reserved_count <= capacity THEN capacity - reserved_count END AS available_count, CAST(fee AS DOUBLE) AS fee, fee = 0 AS is_free, CASE WHEN yn IN ('Y', 'N') THEN yn = 'Y' END AS application_available,
    CASE WHEN yn NOT IN ('Y', 'N') THEN 'invalid aplyYn' WHEN reserved_count > capacity THEN 'reserved exceeds capacity' WHEN e < s THEN 'slot ends before it starts' END AS error FROM v"""


def _occurrences(spark, sf_dir, kind: str) -> DataFrame:
    got = slots.occurrences(_slot_rows(spark, sf_dir, *slots.FIELDS[kind]), kind)
    utc = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return got.select(
        "resource_id", "source_occurrence_id", utc("start_at").alias("start_utc"), utc("end_at").alias("end_utc"), "capacity", "reserved_count", "available_count",
        F.col("fee").cast("double").alias("fee"), "is_free", "application_available", "error",
    )


@register(_slots("EXP"))
def exp_slots(spark, sf_dir):
    return _occurrences(spark, sf_dir, "EXP")


@register(_slots("DAY"))
def day_slots(spark, sf_dir):
    return _occurrences(spark, sf_dir, "DAY")


# Event graphs: orders as events, their lines as occurrences


def _graph(spark, sf_dir, more: int = 0) -> tuple[DataFrame, DataFrame]:
    """A batch of events and occurrences; more: what is added to capacities, so that a batch brings changes."""
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    given = {
        "source_item_key": F.concat(F.lit("ORD_"), k.cast("string")), "title": F.concat(F.lit("Order "), k.cast("string")), "organizer": F.col("o_orderpriority"),
        "event_start": at, "event_end": F.when(k % 7 == 0, F.date_sub(at, 1).cast("timestamp")).otherwise(at), "registration_start_date": F.col("o_orderdate").cast("date"),
        "capacity": (F.col("o_custkey") % 40 + more).cast("int"), "fee": F.col("o_totalprice").cast("decimal(12,2)"), "is_free": k % 2 == 0,
        "source_url": F.concat(F.lit("https://orders.example/"), k.cast("string")), "source_code": F.lit("F300"),
    }
    kinds = schemas.EVENT_CONTENT | {"source_item_key": "string"}
    batch = _t(spark, sf_dir, "orders").select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()), (k % 5 != 0).alias("detail_complete"))
    start = F.col("l_shipdate").cast("timestamp")
    own = {"start_at": start, "end_at": start, "capacity": F.col("q").cast("int"), "reserved_count": F.when(F.col("l_linenumber") == 6, -1).otherwise(0), "application_available": F.col("l_linenumber") % 2 == 0}
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_shipdate").alias("l_shipdate"), F.max("l_quantity").alias("q"))
    content = {c: t for c, t in schemas.OCCURRENCE_CONTENT.items() if c not in ("collected_at", "updated_at")}
    children = lines.select(
        F.concat(F.lit("ORD_"), F.col("l_orderkey").cast("string")).alias("source_item_key"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("source_occurrence_id"),
        *(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in content.items()),
    )
    return batch, children


_LINES_OF = """(SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS id, min(l_shipdate) AS day, CAST(max(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY ALL)"""
_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@register(f"""WITH o AS (SELECT l_orderkey, string_agg('{{"application_available":' || (l_linenumber % 2 = 0) || ',"available_count":null,"capacity":' || q || ',"end_at":"' || {_STAMP.format("day")} || '","fee":null,"is_free":null,"reserved_count":' ||
    CASE WHEN l_linenumber = 6 THEN -1 ELSE 0 END || ',"source_occurrence_id":"' || id || '","start_at":"' || {_STAMP.format("day")} || '"}}', ',' ORDER BY id) AS list FROM {_LINES_OF} GROUP BY 1)
  SELECT 'ORD_' || o_orderkey AS source_item_key, sha256('{{"address":null,"application_method":null,"capacity":' || o_custkey % 40 || ',"capacity_text":null,"description":null,"detail_url":null,"event_end":"' ||
    {_STAMP.format("CASE WHEN o_orderkey % 7 = 0 THEN date_trunc('day', o_orderdate) - INTERVAL 1 DAY ELSE o_orderdate END")} || '","event_end_date":null,"event_period_text":null,"event_start":"' || {_STAMP.format("o_orderdate")} ||
    '","event_start_date":null,"fee":"' || regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR), '\\.?0+$', '') || '","fee_text":null,"image_url":null,"is_free":' || (o_orderkey % 2 = 0) ||
    ',"occurrences":[' || coalesce(list, '') || '],"organizer":"' || o_orderpriority || '","original_category":null,"registration_end":null,"registration_end_date":null,"registration_period_text":null,"registration_start":null,"registration_start_date":"' ||
    strftime(o_orderdate, '%Y-%m-%d') || '","registration_status":null,"reservation_url":null,"source_event_id":null,"source_item_key":"ORD_' || o_orderkey || '","source_url":"https://orders.example/' || o_orderkey ||
    '","target_text":null,"title":"Order ' || o_orderkey || '","venue":null}}') AS content_hash FROM orders LEFT JOIN o ON o_orderkey = l_orderkey""")
def full_hash(spark, sf_dir):
    return hashing.event_hash(*_graph(spark, sf_dir)).select("source_item_key", "content_hash")


def _ingested(spark, sf_dir) -> merge.Ingest:
    """A second batch, of a third of the keys and up to three rows each, on a table that the first one, of most keys, has filled."""
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.EVENTS).schema}
    number = F.regexp_extract("source_item_key", r"(\d+)$", 1).cast("long")
    batch, children = _graph(spark, sf_dir)
    stored = batch.where(number % 10 != 0).drop("detail_complete").withColumns({"id": number, "source_id": F.lit(1).cast("long"), "last_seen_run_id": F.lit(1).cast("long"), "is_active": F.lit(True), "district": F.lit("d")})
    stored = stored.select(*((F.col(c) if c in stored.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    fields = {f.name: f.dataType for f in spark.createDataFrame([], schemas.OCCURRENCES).schema}
    first = F.col("source_occurrence_id").rlike(":[1-3]:")
    lines = children.where(first).withColumns({"event_id": number, "id": F.monotonically_increasing_id()}).where(number % 10 != 0)
    lines = lines.select(*((F.col(c) if c in lines.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))
    times = F.array_compact(F.array(F.lit(1), F.when(number % 2 == 0, 2), F.when(number % 9 == 0, 3)))
    p, line = F.col("pos"), F.split("source_occurrence_id", ":")[1].cast("int")
    new = batch.where(number % 3 == 0).withColumn("pos", F.explode(times))
    late = ((p == 1) & (number % 7 == 0)) | ((p == 2) & (number % 11 == 0)) | ((p == 3) & (number % 13 == 0))
    new = new.withColumns({
        "event_end": F.when(late, F.date_sub("event_start", 1).cast("timestamp")).otherwise(F.col("event_start")), "capacity": F.col("capacity") + p,
        "detail_complete": F.when(p == 1, number % 5 != 0).when(p == 2, number % 4 == 0).otherwise(number % 5 == 1),
    })
    more = children.where(number % 3 == 0).withColumn("pos", F.explode(times)).where((p != 2) | (line <= 4)).withColumn("n", F.explode(F.when(line == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    more = more.withColumns({"capacity": F.col("capacity") + p + 10 * F.col("n"), "reserved_count": F.when(p == 1, F.col("reserved_count")).otherwise(0)})
    at = F.lit("2026-08-01 00:00:00").cast("timestamp")
    return merge.ingest(stored, lines, new, more, 1, 2, at, quality.event_rules(), quality.occurrence_rules())


# Row by row: s is the state after the i-th row of a key.
_REPLAY = f"""WITH RECURSIVE six AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 6),
  k AS (SELECT o_orderkey AS k, o_custkey % 40 AS capacity, o_orderkey % 10 <> 0 AS stored FROM orders WHERE o_orderkey % 3 = 0),
  r AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS i, CASE pos WHEN 1 THEN k % 5 <> 0 WHEN 2 THEN k % 4 = 0 ELSE k % 5 = 1 END AS complete,
      (CASE pos WHEN 1 THEN k % 7 = 0 WHEN 2 THEN k % 11 = 0 ELSE k % 13 = 0 END) AS late, pos = 1 AND k IN (SELECT l_orderkey FROM six) AS bad_child
    FROM k, (VALUES (1), (2), (3)) p(pos) WHERE pos = 1 OR (pos = 2 AND k % 2 = 0) OR (pos = 3 AND k % 9 = 0)),
  s AS (SELECT k, CAST(0 AS BIGINT) AS i, 0 AS pos, stored AS there, 0 AS applied, '' AS outcome FROM k UNION ALL
    SELECT r.k, r.i, r.pos, s.there OR NOT (r.late OR r.bad_child), CASE WHEN r.late OR r.bad_child OR (s.there AND NOT r.complete) THEN s.applied ELSE r.pos END,
      CASE WHEN s.there AND NOT r.complete THEN 'touched' WHEN r.late OR r.bad_child THEN 'failed' WHEN s.there THEN 'updated' ELSE 'inserted' END
    FROM s JOIN r ON r.k = s.k AND r.i = s.i + 1),
  e AS (SELECT k, arg_max(there, i) AS there, arg_max(applied, i) AS applied FROM s GROUP BY k),
  o AS (SELECT s.k, s.pos, l.id, n, q + s.pos + 10 * n AS capacity FROM s JOIN {_LINES_OF} l ON l_orderkey = s.k AND (s.pos <> 2 OR l_linenumber <= 4), (VALUES (1), (2)) t(n) WHERE outcome IN ('inserted', 'updated') AND (n = 1 OR l_linenumber = 1)),
  old AS (SELECT id, q FROM {_LINES_OF} WHERE l_linenumber <= 3 AND l_orderkey % 10 <> 0)"""


@register(f"""{_REPLAY} SELECT 'ORD_' || o_orderkey AS source_item_key, CAST(CASE WHEN applied > 0 THEN o_custkey % 40 + applied ELSE o_custkey % 40 END AS INTEGER) AS capacity, CASE WHEN o_orderkey % 10 <> 0 THEN 'd' END AS district,
    CAST(CASE WHEN k IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS last_seen_run_id, CASE WHEN k IS NULL THEN 'keep' WHEN o_orderkey % 10 = 0 THEN 'insert' WHEN applied > 0 THEN 'update' ELSE 'touch' END AS action,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey END AS old_id FROM orders LEFT JOIN e ON k = o_orderkey WHERE o_orderkey % 10 <> 0 OR there""")
def event_graph(spark, sf_dir):
    after = _ingested(spark, sf_dir).events
    return after.select("source_item_key", "capacity", "district", "last_seen_run_id", "action", F.when(F.col("action") != "insert", F.col("id")).alias("old_id"))


@register(f"""{_REPLAY}, given AS (SELECT id, arg_max(capacity, 10 * pos + n) AS capacity FROM o GROUP BY id)
  SELECT id AS source_occurrence_id, CAST(coalesce(given.capacity, q) AS INTEGER) AS capacity, CASE WHEN q IS NULL THEN 'insert' WHEN given.capacity IS NULL THEN 'keep' ELSE 'update' END AS action FROM old FULL JOIN given USING (id)""")
def occurrence_graph(spark, sf_dir):
    return _ingested(spark, sf_dir).occurrences.select("source_occurrence_id", "capacity", "action")


@register(f"""{_REPLAY} SELECT 'ORD_' || s.k AS source_item_key, s.pos, concat_ws(',', CASE WHEN late THEN 'event_order' END, CASE WHEN bad_child THEN 'reserved_count_sign' END) AS violations FROM s JOIN r ON s.k = r.k AND s.i = r.i WHERE outcome = 'failed'""")
def rejected_events(spark, sf_dir):
    return _ingested(spark, sf_dir).rejected.select("source_item_key", "pos", F.array_join("violations", ",").alias("violations"))


@register(f"{_REPLAY} SELECT 'ORD_' || k AS source_item_key, pos, outcome FROM s WHERE pos > 0")
def event_outcomes(spark, sf_dir):
    return _ingested(spark, sf_dir).outcomes.drop("violations")


@register(f"""{_REPLAY}, f AS (SELECT id, min(pos) AS first FROM o GROUP BY id), x AS (SELECT count(*) FILTER (o.pos = first AND id NOT IN (SELECT id FROM old)) AS new, count(*) AS n FROM o JOIN f USING (id))
  SELECT (SELECT new FROM x) AS occurrences_inserted, (SELECT n - new FROM x) AS occurrences_updated, count(*) AS fetched, count(*) FILTER (outcome <> 'failed') AS persisted, count(*) FILTER (outcome = 'inserted') AS events_inserted,
    count(*) FILTER (outcome IN ('updated', 'touched')) AS events_updated, count(*) FILTER (outcome = 'failed') AS failed FROM s WHERE pos > 0""")
def ingest_counts(spark, sf_dir):
    return _ingested(spark, sf_dir).counts


@register(f"""WITH l AS (SELECT l_orderkey, string_agg(id || '=' || q, ',' ORDER BY day, id) AS occurrences FROM {_LINES_OF} WHERE l_linenumber <= 3 GROUP BY 1)
  SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, CAST(o_custkey % 40 AS INTEGER) AS capacity, 'd' AS district, coalesce(occurrences, '') AS occurrences FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 0""")
def read_model(spark, sf_dir):
    tables = _ingested(spark, sf_dir)
    shown = F.array_join(F.transform("occurrences", lambda x: F.concat_ws("=", x["source_occurrence_id"], x["capacity"].cast("string"))), ",")
    return serve.read_model(tables.stored, tables.stored_children).select("id", "title", "capacity", "district", shown.alias("occurrences"))


@register("""WITH b AS (SELECT s_name AS name, s_suppkey AS id, CAST(s_suppkey % 4 AS INTEGER) AS error_count, s_suppkey % 3 > 0 AS is_active FROM supplier WHERE s_suppkey % 5 <> 0), d AS (SELECT s_name AS name, s_nationkey AS n FROM supplier WHERE s_suppkey % 2 = 0)
  SELECT coalesce(b.name, d.name) AS name, CASE WHEN d.name IS NULL THEN 'old' ELSE 'https://' || n || '.example' END AS base_url, coalesce(b.error_count, 0) AS error_count, CASE WHEN d.name IS NULL THEN b.is_active ELSE TRUE END AS is_active, b.id AS old_id
  FROM b FULL JOIN d ON b.name = d.name""")
def source_upsert(spark, sf_dir):
    k, kinds = F.col("s_suppkey"), {f.name: f.dataType for f in spark.createDataFrame([], schemas.SOURCES).schema}
    known = {"id": k, "name": F.col("s_name"), "base_url": F.lit("old"), "source_type": F.lit("site"), "is_active": k % 3 > 0, "error_count": (k % 4).cast("int")}
    s = _t(spark, sf_dir, "supplier")
    stored = s.where(k % 5 != 0).select(*(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    given = s.where(k % 2 == 0).select(F.col("s_name").alias("name"), F.concat(F.lit("https://"), F.col("s_nationkey").cast("string"), F.lit(".example")).alias("base_url"), F.lit("site").alias("source_type"))
    after = merge.upsert_source(stored, given, F.lit("2026-08-01 00:00:00").cast("timestamp"))
    old = s.where(k % 5 != 0).select(F.col("s_name").alias("name"), k.alias("old_id"))
    return after.select("name", "base_url", "error_count", "is_active").join(old, "name", "left")


@register("""SELECT o_orderkey, o_orderstatus, CASE WHEN k IS NOT NULL THEN 9 ELSE o_custkey % 5 END AS last_seen_run_id, coalesce(k IS NOT NULL OR o_orderkey % 4 > 0, FALSE) AS is_active FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) ON o_orderkey = k""")
def touch_seen(spark, sf_dir):
    none = F.lit(None).cast("timestamp")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", none.alias("last_seen_at"), (F.col("o_custkey") % 5).alias("last_seen_run_id"), (F.col("o_orderkey") % 4 > 0).alias("is_active"), none.alias("updated_at"))
    keys = _t(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.touch(o, keys, ["o_orderkey"], 9, F.current_timestamp()).select("o_orderkey", "o_orderstatus", "last_seen_run_id", "is_active")


_LEDGER = "r AS (SELECT event_id AS id, user_id % 3 AS source_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, user_id % 2 = 0 AS is_complete FROM events)"


def _ledger(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("source_id"), F.col("ts").alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.lit("F300").alias("scope"), (F.col("user_id") % 2 == 0).alias("is_complete_snapshot"),
    )


@register(f"""WITH {_LEDGER}, last AS (SELECT max(id) AS id FROM r WHERE status = 'success' AND is_complete), g AS (SELECT r.id, r.source_id FROM r JOIN last USING (id))
  SELECT p_partkey, p_partkey % 3 = 0 AND NOT (p_partkey % 5 < 4 AND p_size % 3 = g.source_id AND (p_partkey % 2 = 0) IS NOT TRUE) AS is_active FROM part, g""")
def deactivate_stale(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    last = ledger.where(runs.may_deactivate()).agg(F.max("id")).first()[0]
    k = F.col("p_partkey")
    stored = _t(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") % 3).alias("source_id"), F.when(k % 5 < 4, "F300").otherwise("F400").alias("source_code"), F.when(k % 2 == 0, F.lit(last)).alias("last_seen_run_id"),
        (k % 3 == 0).alias("is_active"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return runs.deactivate_stale(stored, ledger, last)[0].select("p_partkey", "is_active")


@register("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END ELSE 'running' END AS status, CASE WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'e' || event_id END AS error_message FROM events""")
def finished_runs(spark, sf_dir):
    e, bad = _t(spark, sf_dir, "events"), F.col("event_type") == "error"
    ledger = e.select(F.col("event_id").alias("id"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message"))
    outcome = e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.when(bad, "failed").otherwise("success").alias("status"), F.when(bad, F.concat(F.lit("e"), F.col("event_id").cast("string"))).otherwise("").alias("error_message"))
    return runs.finished(ledger, outcome)


@register("""SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 4 = 0 THEN 'success' WHEN user_id % 3 > 0 OR event_id % 2 > 0 THEN 'partial' ELSE 'failed' END AS whole_run,
  CASE WHEN user_id % 4 = 0 THEN 'success' WHEN event_id % 2 > 0 THEN 'partial' ELSE 'failed' END AS page_run FROM events""")
def run_statuses(spark, sf_dir):
    errors, upserts = F.col("user_id") % 4, F.col("event_id") % 2
    collection = F.when(F.col("event_type") == "view", "success").otherwise("partial")
    return _t(spark, sf_dir, "events").select("event_id", runs.full_run_status(collection, errors, F.col("user_id") % 3, upserts).alias("whole_run"), runs.page_run_status(errors, upserts).alias("page_run"))


@register("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '"' || value || '"' WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN 'true' WHEN 3 THEN '""' ELSE CAST(-value AS VARCHAR) END AS raw, value FROM events WHERE value IS NOT NULL),
  n AS (SELECT event_id, json_type(raw) AS kind, try_cast(json_extract_string(raw, '$') AS DOUBLE) AS x, json_extract_string(raw, '$') AS s FROM v)
  SELECT event_id, CASE WHEN kind <> 'BOOLEAN' AND x >= 0 THEN round(x, 6) END AS value, CASE WHEN s = '' THEN NULL WHEN kind = 'BOOLEAN' OR x IS NULL OR x < 0 THEN 'invalid fee' END AS error FROM n""")
def strict_decimals(spark, sf_dir):
    number, k = F.col("value").cast("string"), F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit('"'), number, F.lit('"'))).when(k == 1, number).when(k == 2, "true").when(k == 3, '""').otherwise((-F.col("value")).cast("string"))
    got = _t(spark, sf_dir, "events").where("value is not null").select("event_id", strict.decimal(F.try_parse_json(raw), "fee").alias("r"))
    return got.select("event_id", F.round(F.col("r.value").cast("double"), 6).alias("value"), "r.error")


@register("""WITH l AS (SELECT l_orderkey, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS id, min(l_shipdate) AS s FROM lineitem GROUP BY ALL), n AS (
  SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, string_agg(id, ',' ORDER BY s, id) FILTER (i <= 2) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, id) AS i FROM l) GROUP BY 1)
  SELECT 'ORD_' || o_orderkey AS source_item_key, coalesce(n, 0) AS occurrences_count, coalesce(ids, '') AS shown FROM orders LEFT JOIN n ON o_orderkey = l_orderkey""")
def sample_projection(spark, sf_dir):
    batch, children = _graph(spark, sf_dir)
    nested = serve.nested_children(batch, children.select("source_item_key", "source_occurrence_id", "start_at"), "source_item_key", ["start_at", "source_occurrence_id"], "occurrences")
    s = serve.sample(nested, "occurrences")
    return s.select("source_item_key", "occurrences_count", F.array_join(F.transform("occurrences", lambda x: x["source_occurrence_id"]), ",").alias("shown"))


@register("SELECT count(*) AS occurrences FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))")
def nested_total(spark, sf_dir):
    batch, children = _graph(spark, sf_dir)
    nested = serve.nested_children(batch.select("source_item_key"), children.select("source_item_key", "source_occurrence_id"), "source_item_key", ["source_occurrence_id"])
    return nested.agg(F.sum(F.size("children").cast("long")).alias("occurrences"))


# Derived views

_AS_OF = "1996-06-30"


@register(f"""SELECT o_orderkey, CASE WHEN here AND a >= s AND a <= e THEN '현장접수' WHEN a < o THEN '접수예정' WHEN a >= o AND a = c THEN '오늘마감' WHEN a >= o AND a < c AND c - a <= 3 THEN '마감임박' WHEN a >= o AND a < c THEN '접수중'
  WHEN a < s THEN CASE WHEN a > c AND NOT here THEN '접수마감' ELSE '행사예정' END WHEN a >= s AND a <= e THEN '행사중' WHEN a > e THEN '종료' END AS status
  FROM (SELECT o_orderkey, DATE '{_AS_OF}' AS a, CAST(o_orderdate AS DATE) AS o, CAST(o_orderdate AS DATE) + 30 AS c, CAST(o_orderdate AS DATE) + 40 AS s, CAST(o_orderdate AS DATE) + 60 AS e, o_custkey % 5 = 0 AS here FROM orders)""")
def status_asof(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    status = derive.status_at(F.lit(_AS_OF).cast("date"), day, F.date_add(day, 30), F.date_add(day, 40), F.date_add(day, 60), onsite=F.col("o_custkey") % 5 == 0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@register("""SELECT o_orderkey, marker, day FROM (SELECT o_orderkey, 'opens' AS marker, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION ALL
  SELECT o_orderkey, 'closes', strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') FROM orders WHERE o_orderstatus <> 'P')""")
def calendar_unpivot(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", day.alias("open_day"), F.when(F.col("o_orderstatus") != "P", F.date_add(day, 30)).alias("close_day"))
    return derive.calendar(o, "o_orderkey", {"opens": "open_day", "closes": "close_day"}).select("o_orderkey", "marker", F.col("day").cast("string").alias("day"))


@register("""SELECT l_orderkey AS o_orderkey, 'occurrence' AS marker, day, count(*) OVER (PARTITION BY l_orderkey) AS days FROM (SELECT DISTINCT l_orderkey, strftime(l_shipdate + INTERVAL 15 HOUR + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM lineitem)""")
def occurrence_calendar(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_shipdate") + F.expr("INTERVAL 15 HOURS")).alias("at"))
    marked = derive.occurrence_markers(lines, "o_orderkey", "at")
    days = marked.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("days"))
    return marked.join(days, "o_orderkey").select("o_orderkey", "marker", F.col("day").cast("string").alias("day"), "days")


@register(f"""WITH s AS ({_slots("EXP")}), r AS (SELECT DISTINCT CAST(event_id AS VARCHAR) AS resource_id, strftime(ts, '%Y-%m-%d') AS day FROM events UNION SELECT 'none', strftime(max(ts), '%Y-%m-%d') FROM events)
  SELECT r.resource_id, r.day, count(s.resource_id) AS slots, count(s.resource_id) FILTER (s.error IS NULL) AS good, coalesce(string_agg(DISTINCT s.error, ',' ORDER BY s.error), CASE WHEN count(s.resource_id) = 0 THEN 'no answer' ELSE '' END) AS errors
  FROM r LEFT JOIN s ON r.resource_id = s.resource_id AND r.day = split_part(s.source_occurrence_id, ':', 2) GROUP BY 1, 2""")
def slot_answers(spark, sf_dir):
    payloads = _slot_rows(spark, sf_dir, *slots.FIELDS["EXP"])
    last = _t(spark, sf_dir, "events").agg(F.max("ts").cast("date").alias("day")).select(F.lit("none").alias("resource_id"), "day")
    requests = payloads.select("resource_id", "day").distinct().unionByName(last)
    got = normalize.slots_of(requests, slots.occurrences(payloads, "EXP"))
    return got.select("resource_id", F.col("day").cast("string").alias("day"), "slots", "good", F.array_join("errors", ",").alias("errors"))


_DUPLICATES = """WITH e AS (SELECT p_name AS title, p_size AS day, p_type AS venue, p_brand AS organizer, p_partkey % 3 AS source, min(p_partkey) AS k, count(*) AS copies FROM part GROUP BY ALL),
  p AS (SELECT a.k AS a_p_partkey, b.k AS b_p_partkey, a.copies AS a_copies, b.copies AS b_copies, a.title AS x, b.title AS y, a.organizer AS u, b.organizer AS v, a.day = b.day AS d, a.venue = b.venue AS w
    FROM e a JOIN e b ON a.k < b.k AND a.source <> b.source AND (a.day = b.day OR (a.title = b.title AND a.venue = b.venue))),
  s AS (SELECT a_p_partkey, b_p_partkey, a_copies, b_copies, round(50 * (1 - levenshtein(x, y) / greatest(length(x), length(y))) + CASE WHEN d THEN 25 ELSE 0 END + CASE WHEN w THEN 15 ELSE 0 END
    + 10 * (1 - levenshtein(u, v) / greatest(length(u), length(v))), 4) AS score FROM p)
  SELECT *, CASE WHEN score >= 90 THEN 'auto' ELSE 'review' END AS verdict FROM s WHERE score >= 75"""


@register(_DUPLICATES)
def dup_score(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand", (F.col("p_partkey") % 3).alias("source"))
    return derive.duplicate_candidates(p, "p_partkey", "p_name", "p_size", "p_type", "p_brand", "source")


@register("""SELECT c_custkey, round(km, 6) AS km FROM (SELECT c_custkey, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - 35.5) / 2), 2) + cos(radians(35.5)) * cos(radians(lat)) * pow(sin(radians(lon - 129.3) / 2), 2))) AS km
  FROM (SELECT c_custkey, 35.0 + c_custkey % 100 / 100.0 AS lat, 129.0 + c_custkey % 61 / 100.0 AS lon FROM customer)) WHERE km <= 10""")
def nearby(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", (35.0 + F.col("c_custkey") % 100 / 100.0).alias("lat"), (129.0 + F.col("c_custkey") % 61 / 100.0).alias("lon"))
    return derive.nearby(c, "lat", "lon", (35.5, 129.3), 10).select("c_custkey", F.round("km", 6).alias("km"))


@register("""WITH s AS (SELECT s_suppkey, 34.9 + s_suppkey % 97 / 90.0 AS la, CASE WHEN s_suppkey % 2 = 0 THEN 179.95 ELSE 129.2 END + s_suppkey % 7 / 100.0 AS lo FROM supplier),
  c AS (SELECT c_custkey, 35.0 + c_custkey % 100 / 100.0 AS lb, CASE WHEN c_custkey % 2 = 0 THEN -180.0 ELSE 129.0 END + c_custkey % 61 / 100.0 AS lm FROM customer),
  d AS (SELECT s_suppkey, c_custkey, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lm - lo) / 2), 2))) AS km FROM s JOIN c ON abs(la - lb) < 0.1)
  SELECT s_suppkey, count(*) FILTER (km <= 3) AS within_3, count(*) FILTER (km <= 5) AS within_5, count(*) AS within_10, round(min(km), 6) AS nearest FROM d WHERE km <= 10 GROUP BY 1""")
def nearby_counts(spark, sf_dir):
    """Places near the points of a table, in three distances, also across the date line."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    points = _t(spark, sf_dir, "supplier").select("s_suppkey", (34.9 + k % 97 / 90.0).alias("lat"), (F.when(k % 2 == 0, 179.95).otherwise(129.2) + k % 7 / 100.0).alias("lon"))
    places = _t(spark, sf_dir, "customer").select("c_custkey", (35.0 + c % 100 / 100.0).alias("lat"), (F.when(c % 2 == 0, -180.0).otherwise(129.0) + c % 61 / 100.0).alias("lon"))
    near = derive.nearby_counts(points, places, "s_suppkey", "lat", "lon", (3, 5, 10))
    return near.withColumn("nearest", F.round("nearest", 6))


@register("""WITH r AS (SELECT o_orderpriority AS district, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 2 AS INTEGER) AS z FROM orders), s AS (SELECT district, min(a) AS lo, max(z) AS hi FROM r WHERE z >= a GROUP BY 1),
  d AS (SELECT district, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
  SELECT d.district, CAST(d.day AS VARCHAR) AS day, (SELECT count(*) FROM r WHERE r.district = d.district AND r.a <= d.day AND r.z >= d.day) AS n FROM d""")
def running_per_day(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("district"), day.alias("starts"), F.date_add(day, (F.col("o_orderkey") % 40 - 2).cast("int")).alias("ends"))
    return derive.running(o, "starts", "ends", "district").withColumn("day", F.col("day").cast("string"))


@register(f"""SELECT o_orderkey, CAST(o - a AS INTEGER) AS days_to_open, CAST(o + 30 - a AS INTEGER) AS days_to_close, CAST(o + 40 - a AS INTEGER) AS days_to_start, o = a AS opens_today, o + 30 = a AS closes_today,
  dayofweek(o + 40) IN (0, 6) AS on_weekend FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o, DATE '{_AS_OF}' AS a FROM orders)""")
def day_counts(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return _t(spark, sf_dir, "orders").select("o_orderkey", *derive.day_counts(F.lit(_AS_OF).cast("date"), day, F.date_add(day, 30), F.date_add(day, 40)))


@register(f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 - DATE '{_AS_OF}' AS INTEGER) AS days_left FROM orders
  WHERE CAST(o_orderdate AS DATE) <= DATE '{_AS_OF}' AND CAST(o_orderdate AS DATE) + 30 - DATE '{_AS_OF}' BETWEEN 0 AND 3""")
def closing_soon(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", day.alias("opens"), F.date_add(day, 30).alias("closes"))
    return derive.closing_soon(o, F.lit(_AS_OF).cast("date"), "opens", "closes").select("o_orderkey", "days_left")


@register(f"""SELECT * FROM (SELECT o_orderkey, CASE WHEN o - a BETWEEN 1 AND 7 THEN 'opening_soon' WHEN o <= a AND o + 30 - a BETWEEN 0 AND 3 THEN 'closing_soon' WHEN o <= a AND o + 30 - a > 3 THEN 'open_now' END AS phase,
  CAST(CASE WHEN o > a THEN o - a ELSE o + 30 - a END AS INTEGER) AS days_left FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o, DATE '{_AS_OF}' AS a FROM orders)) WHERE phase IS NOT NULL""")
def openings(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", day.alias("opens"), F.date_add(day, 30).alias("closes"))
    return derive.openings(o, F.lit(_AS_OF).cast("date"), "opens", "closes").select("o_orderkey", "phase", "days_left")


@register(f"""SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) <= last_day(DATE '{_AS_OF}' + 1) AND CAST(o_orderdate AS DATE) + 9 >= date_trunc('month', DATE '{_AS_OF}' + 1)
  AND o_orderstatus IN ('O', 'P') AND o_orderkey % 2 = 0 AND o_custkey % 3 < 2""")
def search_filters(spark, sf_dir):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("district"), day.alias("event_start_date"), F.date_add(day, 9).alias("event_end_date"), F.col("o_orderstatus").alias("status"),
        F.array((F.col("o_custkey") % 3).cast("string")).alias("tags"), (k % 2 == 0).alias("is_free"), F.lit("lottery").alias("method"),
    )
    return derive.search(o, F.lit(_AS_OF).cast("date"), ("1-URGENT", "2-HIGH"), "next_month", ("O", "P"), ("0", "1"), True, ("lottery",)).select("o_orderkey")


@register("""SELECT user_id, n, CASE WHEN n > 1 THEN round((epoch_us(b) - epoch_us(a)) / 3.6e9 / (n - 1), 6) END AS mean_hours, CASE WHEN n > 1 THEN (epoch_us(b) - epoch_us(a)) / 3.6e9 / (n - 1) > 24 END AS late
  FROM (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)""")
def run_cadence(spark, sf_dir):
    return derive.cadence(_t(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "n", F.round("mean_hours", 6).alias("mean_hours"), "late")


@register(f"""WITH {_BASE}, {_DELTA} SELECT grp, count(*) FILTER (b IS NULL) AS new, count(*) FILTER (b IS NOT NULL AND d IS NOT NULL AND b <> d) AS changed,
  count(*) FILTER (d IS NULL) AS gone, count(*) FILTER (b = d) AS same FROM (
  SELECT coalesce(b.o_orderkey, d.o_orderkey) % 7 AS grp, b.o_totalprice % 2 < 1 AS b, d.o_totalprice % 3 < 1 AS d FROM b FULL JOIN d ON b.o_orderkey = d.o_orderkey) GROUP BY grp""")
def change_dashboard(spark, sf_dir):
    before = _base(spark, sf_dir).select("o_orderkey", (F.col("o_orderkey") % 7).alias("grp"), (F.col("o_totalprice") % 2 < 1).alias("digest"))
    after = _delta(spark, sf_dir).select("o_orderkey", (F.col("o_orderkey") % 7).alias("grp"), (F.col("o_totalprice") % 3 < 1).alias("digest"))
    return derive.dashboard(*(derive.Snapshot(df, ["o_orderkey"], "digest", "grp", 16) for df in (before, after)))


@register(f"""WITH e AS (SELECT count(*) FILTER (CAST(o_orderdate AS DATE) = DATE '{_AS_OF}') AS collected, count(*) FILTER (CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) < DATE '{_AS_OF}') AS ended FROM orders),
  r AS (SELECT count(*) AS failed_runs FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)), d AS ({_DUPLICATES})
  SELECT collected, ended, failed_runs, (SELECT count(*) FROM d WHERE verdict = 'auto') AS duplicates, (SELECT count(*) FROM d WHERE verdict = 'review') AS to_review FROM e, r""")
def dashboard_totals(spark, sf_dir):
    day, first = F.col("o_orderdate").cast("date"), _t(spark, sf_dir, "events").agg(F.min("ts").cast("date")).first()[0]
    stored = _t(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("collected_at"), day.alias("event_start_date"), F.date_add(day, (F.col("o_orderkey") % 30).cast("int")).alias("event_end_date"))
    shift = F.datediff(F.lit(_AS_OF).cast("date"), F.lit(first))
    ledger = _t(spark, sf_dir, "events").select(F.date_add(F.col("ts").cast("date"), shift).alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return derive.admin_totals(stored, ledger, dup_score(spark, sf_dir), F.lit(_AS_OF).cast("date"))


@register("""WITH s AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok, arg_max(event_type, ts) = 'error' AS bad, max(ts) AS last FROM (SELECT user_id, ts, max(event_type) FILTER (event_type = 'error') AS event_type FROM events GROUP BY ALL
    HAVING count(*) = count(event_type) FILTER (event_type = 'error') UNION ALL SELECT user_id, ts, 'ok' FROM events WHERE event_type <> 'error') GROUP BY 1), m AS (SELECT CAST(max(ts) AS DATE) AS today FROM events)
  SELECT user_id, CASE WHEN ok IS NULL OR today - CAST(ok AS DATE) > 2 THEN '오류' WHEN bad THEN '경고' ELSE '정상' END AS health FROM s, m""")
def source_health(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.every(F.col("event_type") == "error").alias("bad")).withColumn("said", F.lit("failed"))
    today = e.agg(F.max("ts").cast("date")).first()[0]
    status = runs.source_status(e, "user_id", "ts", "ts", F.col("bad"), "said")
    return derive.health(status, F.lit(today)).select("user_id", "health")


@register(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
  g AS (SELECT DISTINCT doc_id, word AS pattern FROM t UNION SELECT DISTINCT a.doc_id, a.word || ' ' || b.word FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i = a.i + 1
    UNION SELECT DISTINCT a.doc_id, a.word || ' ' || b.word || ' ' || c.word FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN t c ON a.doc_id = c.doc_id AND c.i = a.i + 2),
  r AS (SELECT pattern, category, priority, n FROM (SELECT w[1] AS pattern, source AS category, doc_id AS priority, 1 AS n FROM w JOIN documents USING (doc_id) WHERE len(w) > 0
    UNION ALL SELECT w[1] || ' ' || w[2], lang, doc_id, 2 FROM w JOIN documents USING (doc_id) WHERE len(w) > 1 UNION ALL SELECT w[1] || ' ' || w[2] || ' ' || w[3], source || lang, doc_id, 3 FROM w JOIN documents USING (doc_id) WHERE len(w) > 2 AND doc_id % 3 = 0)),
  h AS (SELECT g.doc_id, category FROM g JOIN r USING (pattern) QUALIFY row_number() OVER (PARTITION BY g.doc_id ORDER BY n DESC, length(pattern) DESC, priority, category) = 1)
  SELECT doc_id, coalesce(category, '기타') AS category FROM documents LEFT JOIN h USING (doc_id)""")
def categories(spark, sf_dir):
    """Rules by the first words of texts: as many as three for each document."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    w = F.col("w")
    firsts = [(1, F.col("source"), F.lit(True)), (2, F.col("lang"), F.lit(True)), (3, F.concat("source", "lang"), F.col("doc_id") % 3 == 0)]
    made = F.array_compact(F.array(*(F.when((F.size(w) >= n) & ok, F.struct(F.array_join(F.slice(w, 1, n), " ").alias("pattern"), c.alias("category"))) for n, c, ok in firsts)))
    rules = d.withColumn("w", derive.words(F.col("text"), 4)).select(F.explode(made).alias("r"), F.col("doc_id").alias("priority")).select("r.*", "priority")
    return derive.categories(d, "doc_id", "text", rules)


@register(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(DATE '{_AS_OF}' - CAST(o_orderdate AS DATE) AS INTEGER) END AS age_days,
  coalesce(CASE WHEN o_orderkey % 5 > 0 THEN DATE '{_AS_OF}' - CAST(o_orderdate AS DATE) END > 7, TRUE) AS stale FROM orders""")
def freshness(spark, sf_dir):
    verified = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("date"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", *derive.stale_days(F.lit(_AS_OF).cast("date"), verified))


@register("""WITH s AS (SELECT user_id, max(event_id) AS last_checked, max(event_id) FILTER (event_type <> 'error') AS last_success, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY 1)
  SELECT user_id, last_checked, last_kind, last_success, error_count, CASE WHEN error_count > 0 THEN 'failed ' || last_bad END AS error_message FROM s JOIN (
    SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (last_success IS NULL OR event_id > last_success)) AS error_count,
      max(event_id) FILTER (event_type = 'error' AND (last_success IS NULL OR event_id > last_success)) AS last_bad FROM events e JOIN s ON e.user_id = s.user_id GROUP BY 1) USING (user_id)""")
def source_status(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("said", F.concat(F.lit("failed "), F.col("event_id").cast("string")))
    got = runs.source_status(e, "user_id", "event_id", "event_type", F.col("event_type") == "error", "said")
    return got.select("user_id", F.col("last_checked_at").alias("last_checked"), F.col("last_item_count").alias("last_kind"), F.col("last_success_at").alias("last_success"), "error_count", "error_message")


@register("""SELECT doc_id, n_rows, dup FROM (SELECT source || ':' || lang AS doc_id, count(*) AS n_rows, count(*) <> count(DISTINCT md5(text)) AS dup FROM documents GROUP BY 1)""")
def duplicate_keys_in_runs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("doc_id"), F.md5("text").alias("k"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) != F.count_distinct("k")).alias("dup"))
