import datetime as dt

import pytest
from pyspark.sql import functions as F

from kalends import schemas
from kalends.operators import derive, merge, normalize, quality, runs, serve
from kalends.streaming.upserts import merge_stream

NOW, LATER = dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 2)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_keeps_curated_columns_and_touches_incomplete(spark):
    base = spark.createDataFrame([(1, "a", "north"), (2, "b", "south"), (3, "c", None)], "k int, title string, district string")
    delta = spark.createDataFrame([(1, "A", True), (2, "B", False), (4, "D", False)], "k int, title string, complete boolean")
    got = merge.merged(merge.actions(base, delta, ["k"], F.col("d.complete")), base.columns, ["title"])
    assert rows(got, "k", "title", "district", "action") == [(1, "A", "north", "update"), (2, "b", "south", "touch"), (3, "c", None, "keep"), (4, "D", None, "insert")]
    again = merge.merged(merge.actions(got.drop("action"), delta.where("complete"), ["k"]), base.columns, ["title"]).drop("action")
    twice = merge.merged(merge.actions(again, delta.where("complete"), ["k"]), base.columns, ["title"]).drop("action")
    assert rows(again, "k", "title") == rows(twice, "k", "title")


def test_last_complete_row_wins_else_the_first(spark):
    batch = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True), (1, 3, "c", False), (2, 1, "x", False), (2, 2, "y", False)], "k int, ord int, v string, complete boolean")
    assert rows(merge.last_wins(batch, ["k"], "ord", "complete"), "k", "v") == [(1, "b"), (2, "x")]
    assert rows(merge.last_wins(batch, ["k"], "ord"), "k", "v") == [(1, "c"), (2, "y")]


def test_touch_changes_tracking_alone(spark):
    e = spark.createDataFrame([("a", "t", None, None, False, NOW), ("b", "u", None, None, False, NOW)], "source_item_key string, title string, last_seen_at timestamp, last_seen_run_id long, is_active boolean, updated_at timestamp")
    got = merge.touch(e, spark.createDataFrame([("a",), ("a",), ("z",)], "source_item_key string"), ["source_item_key"], 7, F.lit(LATER))
    assert rows(got, "source_item_key", "title", "last_seen_run_id", "is_active", "updated_at") == [("a", "t", 7, True, LATER), ("b", "u", None, False, NOW)]


def test_ids_are_consecutive(spark):
    got = merge.with_ids(spark.range(50).withColumnRenamed("id", "k"), 11, ["k"], per_part=7)
    assert sorted(r["id"] for r in got.collect()) == list(range(11, 61))


def test_rules_pass_on_null(spark):
    e = spark.createDataFrame([(None,) * len(schemas.EVENTS.split(", "))], schemas.EVENTS.replace("decimal(12,2)", "decimal(12;2)").replace("decimal(10,7)", "decimal(10;7)").replace(";", ","))
    assert e.select(quality.violations(quality.event_rules())).first()[0] == ["title_present", "source_item_key_present", "source_url_present"]
    both = e.withColumn("event_start", F.lit(NOW)).withColumn("event_start_date", F.lit(NOW.date())).withColumn("registration_start", F.lit(LATER)).withColumn("registration_end", F.lit(NOW))
    assert set(both.select(quality.violations(quality.event_rules())).first()[0]) >= {"event_start_precision", "registration_order"}
    o = spark.createDataFrame([(NOW, LATER, -1, "x"), (LATER, NOW, 1, "")], "start_at timestamp, end_at timestamp, capacity int, source_occurrence_id string")
    for c in ("reserved_count", "available_count", "fee"):
        o = o.withColumn(c, F.lit(None).cast("int"))
    assert [r[0] for r in o.select(quality.violations(quality.occurrence_rules())).collect()] == [["capacity_sign"], ["time_order", "id_length"]]


PAGE = "run int, page int, list_count int, succeeded boolean, next_page int, pagination_detected boolean, detail_failures int, error_count int"


@pytest.mark.parametrize(("pages", "reason", "status"), [
    ([(12, True, 2, True), (12, True, 3, True), (5, True, None, True)], "short-page", "success"),
    ([(12, True, 2, True), (12, True, None, True)], "last-page", "success"),
    ([(12, True, 2, True), (0, False, None, False)], "page-failure", "partial"),
    ([(0, False, None, False)], "page-failure", "failed"),
    ([(12, True, 2, True), (5, True, 3, True)], "pagination-conflict", "partial"),
    ([(12, True, None, False)], "pagination-missing", "partial"),
    ([(12, True, 2, True), (12, True, 3, True), (12, True, 4, True)], "max-pages", "partial"),
])
def test_verdict(spark, pages, reason, status):
    df = spark.createDataFrame([(1, n + 1, c, ok, nxt, seen, 0, 0 if ok else 1) for n, (c, ok, nxt, seen) in enumerate(pages)], PAGE)
    got = verdict(df, 3)[1]
    assert (got["stop_reason"], got["status"], got["is_complete_snapshot"]) == (reason, status, status == "success")


def verdict(pages, most=500, repeated=None):
    return {r["run"]: r for r in runs.verdict(runs.chains(pages, ["run"], 12, most), 12, repeated).collect()}


def test_faulty_chains_are_no_snapshots(spark):
    """run 1 is whole; the others lack a page, skip one, lead back, begin late, hold a page that nothing links, or repeat one that failed."""
    chains = {
        1: [(1, 2), (2, 3), (3, 4), (4, None)], 2: [(1, 2), (2, 3), (4, None)], 3: [(1, 2), (2, 3), (3, 4), (4, 5), (5, 8), (8, None)], 4: [(1, 2), (2, 3), (3, 2), (4, None)],
        5: [(2, 3), (3, None)], 6: [(1, 2), (2, None), (7, None)], 7: [(1, 1)], 8: [(n, n + 1 if n < 40 else None) for n in range(1, 41)],
    }
    df = spark.createDataFrame([(r, p, 12, True, n, True, 0, 0) for r, c in chains.items() for p, n in c], PAGE)
    got = verdict(df)
    assert {r: (g["stop_reason"], g["missing_page"], g["loops"], g["pages_followed"], g["pages_unreached"], g["is_complete_snapshot"]) for r, g in got.items()} == {
        1: ("last-page", None, False, 4, 0, True), 2: ("page-missing", 3, False, 2, 1, False), 3: ("page-failure", None, False, 5, 1, False), 4: ("page-loop", None, True, 3, 1, False),
        5: ("page-missing", 1, False, 0, 2, False), 6: ("last-page", None, False, 2, 1, False), 7: ("page-loop", None, True, 1, 0, False), 8: ("last-page", None, False, 40, 0, True),
    }
    assert verdict(df, 39)[8]["stop_reason"] == "max-pages" and got[3]["pages_skipping"] == 1
    again = df.where("run = 1").withColumn("attempt", F.lit(1)).unionByName(spark.createDataFrame([(1, 3, 12, False, None, False, 0, 1, 0)], f"{PAGE}, attempt int"))
    assert verdict(again)[1]["status"] == "success" and verdict(again.withColumn("attempt", -F.col("attempt")))[1]["stop_reason"] == "page-failure"
    steps = {(r["run"], r["page"]): r["step"] for r in runs.followed(df, ["run"], 12).collect()}
    assert all(steps[8, n] == n - 1 for n in range(1, 41)) and steps[2, 4] is None and steps[4, 4] is None


def test_details_dates_slots_and_repeated_keys_reach_the_verdict(spark):
    pages = spark.createDataFrame([(r, 1, 3, True, None, True, 0, 0) for r in range(7)], PAGE)
    items = spark.createDataFrame(
        [(r, 1, f"EXP_{r}", False, f"u{r}", None) for r in range(6)] + [(6, 1, None, True, "out", "invalid date"), (0, 1, None, True, "out", None)],
        "run int, page int, source_event_id string, is_external boolean, detail_url string, parse_error string",
    )
    day = dt.date(2026, 8, 1)
    found = spark.createDataFrame([(f"EXP_{r}", "bad fields" if r == 2 else None, [None] if r == 3 else [day] * (4 if r == 4 else 1)) for r in (0, 2, 3, 4, 5)], "resource_id string, parse_error string, active_dates array<date>")
    answers = spark.createDataFrame([("EXP_0", day, []), ("EXP_5", day, ["no answer"])], "resource_id string, day date, errors array<string>")
    issues = normalize.issues(items, found, ["run"], answers, 3)
    assert rows(issues, "run", "phase", "identifier", "message") == [
        (1, "detail", "EXP_1", "no detail"), (2, "detail", "EXP_2", "bad fields"), (3, "dates", "EXP_3", "invalid active date"), (4, "dates", "EXP_4", "4 active dates, more than 3"),
        (5, "slots", "EXP_5", "2026-08-01: no answer"), (6, "list", "out", "invalid date"),
    ]
    got = verdict(runs.with_issues(pages, issues, ["run"]))
    assert {r: (g["is_complete_snapshot"], g["detail_failure_count"], g["error_count"], g["status"]) for r, g in got.items()} == {
        0: (True, 0, 0, "success"), 1: (False, 1, 1, "partial"), 2: (False, 1, 1, "partial"), 3: (False, 0, 1, "partial"), 4: (False, 0, 1, "partial"), 5: (False, 0, 1, "partial"), 6: (False, 0, 1, "failed"),
    }
    keys = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "a"), (2, None), (2, None)], "run int, source_item_key string")
    got = verdict(pages, repeated=runs.repeated_keys(keys, ["run"]))
    assert [got[r]["is_complete_snapshot"] for r in (0, 1, 2)] == [True, False, True]


def ledger(spark, **change):
    row = {"id": 1, "source_id": 1, "finished_at": LATER, "status": "success", "scope": "F300", "is_complete_snapshot": True, "error_message": None} | change
    return spark.createDataFrame([tuple(row.values())], "id long, source_id long, finished_at timestamp, status string, scope string, is_complete_snapshot boolean, error_message string")


def stored(spark):
    data = [(1, 1, "F300", None, True), (2, 1, "F300", 1, True), (3, 1, "F400", None, True), (4, 1, None, None, True), (5, 2, "F300", None, True), (6, 1, "F300", 9, True), (7, 1, "F300", None, False)]
    return spark.createDataFrame([(*r, NOW) for r in data], "id long, source_id long, source_code string, last_seen_run_id long, is_active boolean, updated_at timestamp")


def test_only_unseen_rows_of_the_scope_become_inactive(spark):
    after, n = runs.deactivate_stale(stored(spark), ledger(spark), 1)
    assert n == 2 and rows(after.where("NOT is_active"), "id") == [(1,), (6,), (7,)]
    assert rows(after.where("id = 1"), "updated_at") == [(LATER,)] and rows(after.where("id = 7"), "updated_at") == [(NOW,)]
    assert runs.deactivate_stale(stored(spark), ledger(spark, scope="full"), 1)[1] == 3


@pytest.mark.parametrize("change", [{"status": "partial"}, {"is_complete_snapshot": False}, {"finished_at": None}, {"scope": "F300:page-1-test"}, {"id": 2}])
def test_gate_refuses(spark, change):
    with pytest.raises(ValueError, match="snapshot"):
        runs.deactivate_stale(stored(spark), ledger(spark, **change), 1)


def test_only_running_runs_are_finished(spark):
    outcome = spark.createDataFrame([(1, "failed", "x" * 10_050)], "id long, status string, error_message string")
    got = runs.finished(ledger(spark, status="running"), outcome).first()
    assert got["status"] == "failed" and len(got["error_message"]) == 10_000
    with pytest.raises(ValueError, match="not running"):
        runs.finished(ledger(spark), outcome)


def test_failure_streak_and_messages(spark):
    df = spark.createDataFrame([(1, n, bad) for n, bad in enumerate([True, True, False, True])], "s int, n int, bad boolean")
    assert rows(runs.failure_streaks(df, "s", ["n"], F.col("bad")), "n", "error_count") == [(0, 1), (1, 2), (2, 0), (3, 1)]
    said = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "n int, m string").agg(runs.joined_errors("n", "m")).first()[0]
    assert said == "a | b" and spark.createDataFrame([(1, None)], "n int, m string").agg(runs.joined_errors("n", "m")).first()[0] is None
    got = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "e int, u int").select(runs.page_run_status(F.col("e"), F.col("u"))).collect()
    assert [r[0] for r in got] == ["success", "partial", "failed"]


@pytest.mark.parametrize("per_slice", [7, 200_000])
def test_streaks_across_slices(spark, per_slice):
    """One source has most runs; some have nothing but failures over many slices."""
    import random

    rnd = random.Random(3)
    data = [(rnd.choice([1, 1, 1, 1, 2, None]), n, n < 60 or rnd.random() < 0.8) for n in range(400)] + [(9, n, True) for n in range(50)]
    want, at = {}, {}
    for s, n, bad in data:
        at[s] = at.get(s, 0) + 1 if bad else 0
        want[s, n] = at[s]
    rnd.shuffle(data)
    got = runs.failure_streaks(spark.createDataFrame(data, "s int, n int, bad boolean"), "s", ["n"], F.col("bad"), per_slice).collect()
    assert {(r["s"], r["n"]): r["error_count"] for r in got} == want and len(got) == len(want)


def test_a_deep_page_reads_one_slice(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") % 5 > 0, F.expr("timestamp_seconds(id * 7919 % 3001)")).alias("at"))
    index = serve.RankIndex(df, "at", "id", 500)
    assert index.total == 10_000 and len(index.sizes) >= 15
    for limit, offset in ((20, 9000), (100, 0), (37, index.sizes[0][1] - 10), (100, 9950), (10, 10_000)):
        assert index.page(limit, offset).collect() == serve.page(df, "at", "id", limit, offset).collect()
    files = {r[0] for r in index.page(20, index.sizes[0][1] + 5).select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 1 or all("_slice=1/" in f for f in files)
    assert serve.RankIndex(df.limit(0), "at", "id").page(5, 0).collect() == []


@pytest.mark.parametrize("km", [3, 5, 10])
def test_places_near_many_points(spark, km):
    import math
    import random

    rnd = random.Random(km)
    places = []
    for n in range(600):
        lat, lon = rnd.choice([(35.5, 129.3), (0.0, 180.0), (89.97, 0.0), (-89.99, 50.0), (70.0, -180.0)])
        lat, lon = max(-90.0, min(90.0, lat + rnd.uniform(-0.2, 0.2))), (lon + rnd.uniform(-0.4, 0.4) if abs(lat) < 80 else rnd.uniform(-180, 180))
        places.append((n, lat, (lon + 180) % 360 - 180))
    points = [(n, a, b) for n, a, b in places[::5]] + [(900, 90.0, 0.0), (901, -90.0, 77.0), (902, None, 1.0), (903, 0.0, -180.0), (904, 0.0, 180.0)]

    def apart(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * derive.RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))

    want = {(p, q) for p, a, b in points if a is not None for q, c, d in places if apart(a, b, c, d) <= km}
    frames = [spark.createDataFrame(rows_, f"{name} int, lat double, lon double") for rows_, name in ((points, "p"), (places, "q"))]
    got = [(r["p"], r["q"]) for r in derive.nearby_points(*frames, "lat", "lon", km).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_places_near_points_that_share_spots(spark):
    """Twenty thousand places and two thousand points stand in a few spots; only spots are measured against each other."""
    lat, lon = (lambda at: 35.0 + at % 5 / 50.0), (lambda at: F.when(at % 2 == 0, -179.99).otherwise(179.98) + at % 3 / 500.0)
    points = spark.range(2000).select((F.col("id") % 1000).alias("p"), lat(F.col("id") % 1000).alias("lat"), lon(F.col("id") % 1000).alias("lon"))
    points = points.unionByName(spark.createDataFrame([(0, None, 1.0), (5000, 10.0, 10.0), (None, 35.0, 180.0)], "p long, lat double, lon double"))
    places = spark.range(20_000).select(F.col("id").alias("q"), lat(F.col("id")).alias("lat"), lon(F.col("id")).alias("lon")).unionByName(spark.createDataFrame([(-1, None, None), (-2, 35.0, None)], "q long, lat double, lon double"))
    every = derive.nearby_points(points, places, "lat", "lon", 10)
    want = every.groupBy("p").agg(*(F.count_if(F.col("km") <= d).alias(f"within_{d}") for d in (3, 5, 10)), F.min("km").alias("nearest"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, n = shuffled(spark, lambda: derive.nearby_counts(points, places, "p", "lat", "lon", (3, 5, 10)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and len(got) == 1001
    assert n < 12_000


def test_unchanged_buckets_are_not_read(spark):
    before = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    after = before.where("id <> 5").withColumn("d", F.when(F.col("id") == 7, "x").otherwise(F.col("d"))).unionByName(spark.range(2000, 2001).select("id", F.lit(2).cast("long").alias("g"), F.lit("n").alias("d")))
    a, b = (derive.Snapshot(df, ["id"], "d", "g", 64) for df in (before, after))
    got = derive.dashboard(a, b)
    assert rows(got, "g", "new", "changed", "gone", "same") == [(0, 0, 0, 0, 334), (1, 0, 1, 0, 332), (2, 1, 0, 1, 332)]
    assert 1 <= len(a.changed(b)) <= 3 and a.changed(a) == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [bucket") + plan.count("PartitionFilters: [NOT bucket") + plan.count("PartitionFilters: [isnotnull(bucket") >= 2
    assert rows(derive.dashboard(a, a), "g", "same") == [(0, 334), (1, 333), (2, 333)]


def test_longest_rule_wins(spark):
    rules = spark.createDataFrame([("space", "science", 2), ("space camp", "family", 9), ("camp", "outdoor", 1), ("of space", "x", 5), ("to camp", "y", 4), ("", "none", 0), (None, "none", 0)], "pattern string, category string, priority int")
    texts = spark.createDataFrame([(1, "a space  camp\nfor all"), (2, "camp in space"), (3, "spaces"), (4, None), (5, "go to camp of space"), (6, "")], "id int, text string")
    assert rows(derive.categories(texts, "id", "text", rules), "id", "category") == [(1, "family"), (2, "science"), (3, "기타"), (4, "기타"), (5, "x"), (6, "기타")]
    assert rows(derive.categories(texts, "id", "text", rules.limit(0)), "id", "category") == [(n, "기타") for n in range(1, 7)]


def shuffled(spark, df):
    """The rows of df, and how many rows its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (every.apply(i) for every in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for i in range(every.size()))}
    bus, before = spark.sparkContext._jsc.sc().listenerBus(), stages()
    got = (df() if callable(df) else df).collect()
    bus.waitUntilEmpty(30_000)
    return got, sum(n for k, n in stages().items() if k not in before)


def test_rules_of_one_pattern_end_with_nulls(spark):
    rules = spark.createDataFrame([("a", None, 1), ("a", "x", 1), ("b", "y", None), ("b", "z", 7), ("c", None, 1), ("c", "w", 2)], "pattern string, category string, priority int")
    texts = spark.createDataFrame([(1, "a"), (2, "\x0b b\t"), (3, "c"), (None, "a"), (None, "q")], "id int, text string")
    assert {r["id"]: r["category"] for r in derive.categories(texts, "id", "text", rules).collect()} == {1: "x", 2: "z", 3: "기타", None: "x"}


def test_categories_shuffle_a_row_for_each_text(spark):
    """Texts of a hundred words, that all begin alike, and as many rules of that beginning."""
    texts = spark.range(400).select("id", F.concat(F.lit("the"), *(F.concat(F.lit(" "), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5000)).cast("string")) for i in range(100))).alias("text")).repartition(2)
    rules = texts.select(F.lit("the").alias("pattern"), F.col("id").cast("string").alias("category"), F.col("id").alias("priority")).unionByName(
        texts.select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("pattern"), F.lit("three").alias("category"), F.col("id").alias("priority")).where("id % 2 = 0"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the rules were many
    try:
        got, n = shuffled(spark, lambda: derive.categories(texts, "id", "text", rules))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["id"], r["category"]) for r in got) == [(i, "0" if i % 2 else "three") for i in range(400)]
    assert n < 6000


@pytest.mark.parametrize("near", [0, 2000, 1 << 26])
def test_rules_that_not_every_task_gets(spark, monkeypatch, near):
    import random

    monkeypatch.setattr(derive, "NEAR_BYTES", near)
    monkeypatch.setattr(derive, "SLOTS", 256)
    rnd = random.Random(5)
    run = lambda n, m: " ".join(rnd.choice("abcdefgh") * rnd.choice([1, 1, 1, 2, 30]) for _ in range(rnd.randint(n, m)))
    texts = [(k // 2, run(0, 20)) for k in range(80)]
    rules = [(run(1, 4), rnd.choice("uvwxyz"), rnd.randint(0, 3)) for _ in range(150)]
    want = {}
    for k, t in texts:
        w = t.split()
        runs_ = {" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1)}
        want.setdefault(k, []).extend((-p.count(" "), -len(p), o, c) for p, c, o in rules if p in runs_)
    got = derive.categories(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame(rules, "pattern string, category string, priority int"))
    assert rows(got, "id", "category") == [(k, min(v)[-1] if v else "기타") for k, v in sorted(want.items())]


def test_what_runs_each_day(spark):
    d = dt.date
    data = [("a", d(2026, 1, 30), d(2026, 2, 2)), ("a", d(2026, 2, 2), None), ("a", d(2026, 3, 5), d(2026, 3, 5)), ("b", d(2026, 5, 1), d(2026, 4, 1)), ("b", None, d(2026, 4, 1)), (None, d(2026, 1, 1), d(2026, 1, 1))]
    got = {(r["g"], r["day"]): r["n"] for r in derive.running(spark.createDataFrame(data, "g string, s date, e date"), "s", "e", "g").collect()}
    assert len(got) == 36 - 1 and {k[1]: n for k, n in got.items() if n} == {d(2026, 1, 30): 1, d(2026, 1, 31): 1, d(2026, 2, 1): 1, d(2026, 2, 2): 2, d(2026, 3, 5): 1}


def test_pages_and_samples(spark):
    df = spark.createDataFrame([(1, None, True, "x"), (2, LATER, True, "x"), (3, NOW, True, "y"), (4, NOW, None, "y"), (5, NOW, False, "z")], "id int, at timestamp, is_active boolean, kind string")
    shown = serve.envelope(serve.active(df), "at", "id", 2, 1)
    assert [r["id"] for r in shown["items"]] == [2, 1] and shown["total"] == 3
    for limit, offset in ((0, 0), (101, 0), (1, -1)):
        with pytest.raises(ValueError, match="limit"):
            serve.page(df, "at", "id", limit, offset)
    assert [r["id"] for r in serve.representatives(df, "kind", "id", 3).collect()] == [1, 3, 5]
    assert [r["id"] for r in serve.representatives(df.where("kind <> 'z'"), "kind", "id", 3).collect()] == [1, 3, 2]


def test_derived(spark):
    d = lambda n: F.date_add(F.lit(NOW.date()), n)
    got = [spark.range(1).select(derive.status_at(d(n), d(0), d(10), d(20), d(30))).first()[0] for n in (-1, 0, 8, 10, 15, 25, 31)]
    assert got == ["접수예정", "접수중", "마감임박", "오늘마감", "접수마감", "행사중", "종료"]
    got = [spark.range(1).select(derive.status_at(d(n), F.lit(None).cast("date"), F.lit(None).cast("date"), d(20), d(30), onsite=F.lit(True))).first()[0] for n in (15, 20, 30, 31)]
    assert got == ["행사예정", "현장접수", "현장접수", "종료"]
    assert spark.range(1).select(derive.kilometres(F.lit(35.0), F.lit(129.0), F.lit(36.0), F.lit(129.0))).first()[0] == pytest.approx(111.195, abs=0.01)


def test_stream_merges_each_batch_once(spark, tmp_path):
    landed, table, state = (f"file://{tmp_path}/{n}" for n in ("in", "table", "state"))
    schema = "k int, ord int, v string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], schema).coalesce(1).write.parquet(landed)
    merge_stream(spark, landed, schema, table, ["k"], "ord", state).awaitTermination()
    spark.createDataFrame([(2, 2, "y")], schema).coalesce(1).write.mode("append").parquet(landed)
    for _ in range(2):
        merge_stream(spark, landed, schema, table, ["k"], "ord", state).awaitTermination()
    from kalends.sources import store

    assert store.versions(spark, table) == [1, 2]
    assert rows(store.read(spark, table, f"{schema}, seen_batch bigint"), "k", "v") == [(1, "b"), (2, "y")]


def test_a_replayed_batch_tells_again_and_stores_nothing(spark, tmp_path):
    landed, table, state = (f"file://{tmp_path}/{n}" for n in ("in", "table", "state"))
    schema, told = "k int, ord int, v string", []
    spark.createDataFrame([(1, 1, "a"), (2, 1, "x")], schema).coalesce(1).write.parquet(landed)
    for _ in range(2):
        merge_stream(spark, landed, schema, table, ["k"], "ord", state, after=lambda df, n: told.append(rows(df, "k", "v", "action"))).awaitTermination()
        for f in (tmp_path / "state/commits").iterdir():  # as if the driver had died before it noted the batch
            f.rename(tmp_path / f"gone-{len(told)}-{f.name}")
    from kalends.sources import store

    assert told == [[(1, "a", "insert"), (2, "x", "insert")], [(1, "a", "replayed"), (2, "x", "replayed")]] and store.versions(spark, table) == [1]


def test_a_new_checkpoint_is_a_new_stream(spark, tmp_path):
    table, schema = f"file://{tmp_path}/table", "k int, ord int, v string"
    for n in (1, 2):
        landed = f"file://{tmp_path}/in{n}"
        spark.createDataFrame([(n, 1, "x")], schema).coalesce(1).write.parquet(landed)
        merge_stream(spark, landed, schema, table, ["k"], "ord", f"file://{tmp_path}/state{n}").awaitTermination()
    from kalends.sources import store

    assert rows(store.read(spark, table, schema), "k") == [(1,), (2,)]


def test_places_near_a_pole_and_the_date_line(spark):
    at = spark.createDataFrame([(1, 70.0, 25.2), (2, 70.0, 25.4), (3, 70.05, 25.0)], "id int, lat double, lon double")
    assert rows(derive.nearby(at, "lat", "lon", (70.0, 25.0), 10), "id") == [(1,), (3,)]
    line = spark.createDataFrame([(1, 0.0, -179.99), (2, 0.0, 179.9), (3, 0.0, 0.0)], "id int, lat double, lon double")
    assert rows(derive.nearby(line, "lat", "lon", (0.0, 179.98), 10), "id") == [(1,), (2,)]
    assert rows(derive.nearby(spark.createDataFrame([(1, 89.99, -100.0)], "id int, lat double, lon double"), "lat", "lon", (89.99, 80.0), 10), "id") == [(1,)]


def test_candidates_are_those_of_all_pairs(spark):
    titles, data = ["clay for all", "clay for alle", "night of stars", None], []
    for n in range(60):
        data.append((n, titles[n % 4], n % 3 or None, f"v{n % 2}", f"o{n % 5}", f"s{n % 2 + n // 30}"))
    df = spark.createDataFrame(data, "k int, title string, day int, venue string, organizer string, source string")
    kinds, want = {}, {}
    for k, *rest in data:
        kinds.setdefault(tuple(rest), []).append(k)
    firsts = sorted((v[0], len(v), kind) for kind, v in kinds.items())

    def like(a, b):
        if not a or not b:
            return 0
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
        return 1 - d[-1] / max(len(a), len(b))

    for i, (a, n, (t, day, venue, org, src)) in enumerate(firsts):
        for b, m, (u, day2, venue2, org2, src2) in firsts[i + 1 :]:
            score = 50 * like(t, u) + 25 * (day is not None and day == day2) + 15 * (venue == venue2) + 10 * like(org, org2)
            if src != src2 and score >= 75:
                want[a, b] = (n, m, round(score, 4))
    got = {(r["a_k"], r["b_k"]): (r["a_copies"], r["b_copies"], r["score"]) for r in derive.duplicate_candidates(df, "k", "title", "day", "venue", "organizer", "source").collect()}
    assert got == want and any(v[2] < 90 for v in got.values())


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def test_similar_texts_are_those_of_all_pairs(spark):
    import random

    rnd = random.Random(7)
    words = [" ".join(rnd.choices(["night", "of", "stars", "clay", "for", "all", "2026"], k=rnd.randrange(1, 6))) for _ in range(60)] + ["", None, "a", "가나다라 마바사", "가나다라 마바"]
    for w in words[:60]:
        t = list(w)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "q"])
        words.append("".join(t))
    data = [(n % 65 % 2 if n % 29 else None, w) for n, w in enumerate(words)]
    want = {(d, *sorted((u, v))) for d, u in data for e, v in data if d == e and d is not None and u and v and u < v and distance(u, v) <= 0.2 * max(len(u), len(v))}
    got = [tuple(r) for r in derive.similar_texts(spark.createDataFrame(data, "day int, title string"), ["day"], "title", 0.2).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_fifty_thousand_titles_of_one_day(spark):
    """All begin alike; every tenth has a partner two edits away. What is dealt out grows with the titles, not with their square."""
    base = spark.range(50_000).select("id", F.concat(F.lit("night "), F.substring(F.base64(F.unhex(F.md5(F.col("id").cast("string")))), 1, 18)).alias("title"), F.lit(1).alias("day"))
    twins = base.where("id % 10 = 0").select((F.col("id") + 50_000).alias("id"), F.concat("title", F.lit("xy")).alias("title"), "day")
    found = derive.similar_texts(base.unionByName(twins), ["day"], "title", 0.2)
    assert found.where("y = concat(x, 'xy')").count() == 5000


def test_ingest_twice_changes_nothing_more(spark):
    content = {"title": "t", "source_url": "u", "source_item_key": "a", "detail_complete": True}
    kinds = schemas.EVENT_CONTENT | {"source_item_key": "string", "detail_complete": "boolean"}

    def batch(**more):
        values = content | more
        return spark.range(1).select(*(F.lit(values.get(c)).cast(t).alias(c) for c, t in kinds.items()))

    events, lines = (spark.createDataFrame([], s) for s in (schemas.EVENTS, schemas.OCCURRENCES))
    kids = spark.createDataFrame([("a", "a:1", NOW, LATER), ("a", "a:0", NOW, LATER)], "source_item_key string, source_occurrence_id string, start_at timestamp, end_at timestamp")
    for c, t in schemas.OCCURRENCE_CONTENT.items():
        if c not in kids.columns and c not in ("collected_at", "updated_at"):
            kids = kids.withColumn(c, F.lit(None).cast(t))
    hashes = []
    for run, more in enumerate([{}, {}, {"title": "other"}, {"title": "part", "detail_complete": False}, {"title": None}], 1):
        got = merge.ingest(events, lines, batch(**more), kids, 5, run, F.lit(LATER), quality.event_rules(), quality.occurrence_rules())
        events, lines = spark.createDataFrame(got.events.drop("action").collect(), events.schema), spark.createDataFrame(got.occurrences.drop("action").collect(), lines.schema)
        r = events.first()
        hashes.append((r["title"], r["content_hash"], r["last_seen_run_id"], got.rejected.count()))
        assert (events.count(), lines.count(), r["id"], lines.agg(F.min("event_id"), F.max("event_id")).first()[:]) == (1, 2, 1, (1, 1))
    assert [(h[0], h[2], h[3]) for h in hashes] == [("t", 1, 0), ("t", 2, 0), ("other", 3, 0), ("other", 4, 0), ("other", 5, 1)]
    assert hashes[0][1] == hashes[1][1] != hashes[2][1] == hashes[3][1] == hashes[4][1]


EVENT_KINDS = schemas.EVENT_CONTENT | {"source_item_key": "string", "detail_complete": "boolean", "pos": "int"}
CHILD_KINDS = {c: t for c, t in schemas.OCCURRENCE_CONTENT.items() if c not in ("collected_at", "updated_at")} | {"source_item_key": "string", "source_occurrence_id": "string", "pos": "int", "n": "int"}


def given(spark, kinds, data):
    """Rows of these columns, others null."""
    names = list(data[0]) if data else []
    df = spark.createDataFrame([tuple(d.values()) for d in data], ", ".join(f"{n} {kinds[n]}" for n in names)) if data else spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in kinds.items()))
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))


def stored_tables(spark, events, lines):
    """Stored tables from {key: (id, title)} and {(event_id, occurrence id): capacity}."""
    kinds = dict(c.split(" ", 1) for c in schemas.EVENTS.split(", "))
    e = given(spark, kinds, [{"id": i, "source_id": 5, "source_item_key": k, "title": t, "is_active": False} for k, (i, t) in events.items()])
    kinds = dict(c.split(" ", 1) for c in schemas.OCCURRENCES.split(", "))
    return e, given(spark, kinds, [{"id": n, "event_id": i, "source_occurrence_id": o, "capacity": c} for n, ((i, o), c) in enumerate(lines.items(), 1)])


def replay(events, lines, batch, kids):
    """Row by row, as a reader stores events: {key: title}, {(key, occurrence): capacity}, keys seen, outcomes."""
    titles, held, seen, out = {k: t for k, (_, t) in events.items()}, {}, set(), {}
    of = {i: k for k, (i, _) in events.items()}
    held = {(of[i], o): c for (i, o), c in lines.items()}
    for r in sorted(batch, key=lambda r: r["pos"]):
        k, own = r["source_item_key"], [c for c in kids if (c["source_item_key"], c["pos"]) == (r["source_item_key"], r["pos"])]
        if not r["detail_complete"] and k in titles:
            out[k, r["pos"]] = "touched"
        elif k is None or r["title"] is None or any((c["capacity"] or 0) < 0 for c in own):
            out[k, r["pos"]] = "failed"
        else:
            out[k, r["pos"]] = "updated" if k in titles else "inserted"
            titles[k] = r["title"]
            held |= {(k, c["source_occurrence_id"]): c["capacity"] for c in sorted(own, key=lambda c: c["n"])}
        if k in titles:
            seen.add(k)
    return titles, held, seen, out


def test_a_batch_is_replayed_row_by_row(spark):
    import random

    rnd = random.Random(4)
    events = {f"k{i}": (i + 1, f"old{i}") for i in range(40)}
    lines = {(i + 1, f"o{j}"): 100 + j for i in range(40) for j in range(i % 3)}
    batch, kids = [], []
    for pos in range(400):
        k = rnd.choice([f"k{rnd.randrange(120)}", "k7", "k111", None if pos % 50 == 0 else "k3"])
        batch.append({"source_item_key": k, "title": None if rnd.random() < 0.3 else f"t{pos}", "source_url": "u", "detail_complete": rnd.choice([True, False, None]), "pos": pos})
        for n in range(rnd.randrange(4)):
            c = {"source_item_key": k, "source_occurrence_id": f"o{rnd.randrange(3)}", "start_at": NOW, "end_at": NOW, "capacity": -1 if rnd.random() < 0.1 else 10 * pos + n, "pos": pos, "n": n}
            kids.append(c)
    titles, held, seen, out = replay(events, lines, batch, kids)
    e, o = stored_tables(spark, events, lines)
    got = merge.ingest(e, o, given(spark, EVENT_KINDS, batch), given(spark, CHILD_KINDS, kids), 5, 9, F.lit(LATER), quality.event_rules(), quality.occurrence_rules())
    after = got.events.collect()
    assert {r["source_item_key"]: r["title"] for r in after} == titles and len(after) == len(titles)
    assert {r["source_item_key"] for r in after if r["last_seen_run_id"] == 9} == seen and all(r["is_active"] == (r["source_item_key"] in seen) for r in after)
    ids = {r["id"]: r["source_item_key"] for r in after}
    assert sorted(ids) == list(range(1, len(after) + 1)) and all(ids[i] == k for k, (i, _) in events.items())
    children = got.occurrences.collect()
    assert {(ids[r["event_id"]], r["source_occurrence_id"]): r["capacity"] for r in children} == held and len(children) == len(held) and sorted(r["id"] for r in children) == list(range(1, len(held) + 1))
    assert {(r["source_item_key"], r["pos"]): r["outcome"] for r in got.outcomes.collect()} == out
    counts = got.counts.first()
    kinds = list(out.values())
    assert (counts["fetched"], counts["failed"], counts["events_inserted"], counts["events_updated"]) == (400, kinds.count("failed"), kinds.count("inserted"), kinds.count("updated") + kinds.count("touched"))
    assert counts["persisted"] == 400 - kinds.count("failed") and got.rejected.count() == kinds.count("failed")
    stored_now = {(r["source_item_key"], r["pos"]) for r in batch if out[r["source_item_key"], r["pos"]] in ("inserted", "updated")}
    assert counts["occurrences_inserted"] + counts["occurrences_updated"] == sum((c["source_item_key"], c["pos"]) in stored_now for c in kids)


def test_an_incomplete_row_of_a_stored_event_brings_no_occurrences(spark):
    e, o = stored_tables(spark, {"a": (1, "t")}, {(1, "x"): 1})
    batch = [{"source_item_key": "a", "title": "n", "source_url": "u", "detail_complete": False, "pos": 0}]
    kids = [{"source_item_key": "a", "source_occurrence_id": i, "start_at": NOW, "end_at": NOW, "capacity": 9, "pos": 0, "n": 0} for i in "xy"]
    got = merge.ingest(e, o, given(spark, EVENT_KINDS, batch), given(spark, CHILD_KINDS, kids), 5, 2, F.lit(LATER), quality.event_rules(), quality.occurrence_rules())
    assert rows(got.occurrences, "source_occurrence_id", "capacity", "action") == [("x", 1, "keep")] and rows(got.events, "title", "action", "last_seen_run_id") == [("t", "touch", 2)]


def test_a_valid_row_outlives_a_later_invalid_one_and_the_last_repeated_child_counts(spark):
    e, o = stored_tables(spark, {}, {})
    batch = [{"source_item_key": "a", "title": t, "source_url": "u", "detail_complete": True, "pos": n} for n, t in enumerate(["good", None])]
    kids = [{"source_item_key": "a", "source_occurrence_id": "x", "start_at": NOW, "end_at": NOW, "capacity": c, "pos": 0, "n": c} for c in (1, 2)]
    got = merge.ingest(e, o, given(spark, EVENT_KINDS, batch), given(spark, CHILD_KINDS, kids), 5, 2, F.lit(LATER), quality.event_rules(), quality.occurrence_rules())
    assert rows(got.events, "title", "action") == [("good", "insert")] and rows(got.occurrences, "id", "capacity") == [(1, 2)]
    assert rows(got.rejected, "pos", "violations") == [(1, ["title_present"])] and got.counts.first()["occurrences_inserted"] == 2


def test_sources_keep_their_counters(spark):
    given = spark.createDataFrame([("a", "x", "site"), ("b", "y", "site")], "name string, base_url string, source_type string")
    stored = spark.createDataFrame([(4, "a", "old", 3, False)], "id long, name string, base_url string, error_count int, is_active boolean")
    for c in ("source_type", "created_at", "updated_at"):
        stored = stored.withColumn(c, F.lit(None).cast("string" if c == "source_type" else "timestamp"))
    assert rows(merge.upsert_source(stored, given, F.lit(NOW)), "id", "name", "base_url", "error_count", "is_active") == [(4, "a", "x", 3, True), (5, "b", "y", 0, True)]


def test_started_runs_get_the_next_id(spark):
    empty = spark.createDataFrame([], schemas.RUNS)
    one = runs.started(empty, 3, "F300", F.lit(NOW))
    assert rows(runs.started(one, 3, "full", F.lit(NOW)), "id", "source_id", "status", "scope") == [(1, 3, "running", "F300"), (2, 3, "running", "full")]


@pytest.mark.parametrize(("text", "low", "high", "tags"), [
    ("초등 저학년", 7, 9, ["초등"]), ("8~10세 어린이", 8, 10, ["초등"]), ("유아, 성인", None, None, ["유아", "성인"]), ("만 6세 이상", 6, None, []), ("누구나", None, None, []),
])
def test_ages(spark, text, low, high, tags):
    got = spark.range(1).select(derive.ages(F.lit(text)).alias("r")).first()["r"]
    assert (got["age_min"], got["age_max"], got["tags"]) == (low, high, tags)


def test_methods_and_periods(spark):
    said = spark.createDataFrame([("선착순 20명",), ("신청 후 추첨",), ("온라인 신청",), ("현장접수",), ("?",), (None,)], "m string")
    assert [r[0] for r in said.select(derive.method(F.col("m"))).collect()] == ["first_come", "lottery", "online_reservation", "onsite_registration", None, None]
    day = F.lit(dt.date(2026, 8, 6))  # a Thursday
    got = {n: tuple(x.isoformat()[5:] for x in spark.range(1).select(*derive.period(day, n)).first()) for n in ("this_week", "next_weekend", "this_month", "next_month")}
    assert got == {"this_week": ("08-03", "08-09"), "next_weekend": ("08-15", "08-16"), "this_month": ("08-01", "08-31"), "next_month": ("09-01", "09-30")}
