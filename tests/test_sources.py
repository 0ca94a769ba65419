import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kalends.operators import normalize, runs
from kalends.sources import html, landing, slots, store

EXP = {"stTm": "14:20", "enTm": "15:05", "oprtId": 71, "useLmtNmpr": 9, "rsvCnt": 2, "aplyYn": "Y", "fee": "0", "memo": "rain or shine"}
DAY = {"fee": None, "curNope": 8, "lmtNmpr": 8, "aplyYn": "N", "enTm": "21:00", "stTm": "19:40"}


def payloads(spark, *bodies):
    return spark.createDataFrame([("R_1", dt.date(2026, 8, 11), b if isinstance(b, str) or b is None else json.dumps(b)) for b in bodies], "resource_id string, day date, payload string")


def test_exp_slot(spark):
    r = slots.occurrences(payloads(spark, "﻿" + json.dumps([EXP])), "EXP").first()
    assert r["source_occurrence_id"] == "R_1:2026-08-11:71" and r["error"] is None
    assert (r["capacity"], r["reserved_count"], r["available_count"], r["is_free"], r["application_available"]) == (9, 2, 7, True, True)
    assert r["start_at"] == dt.datetime(2026, 8, 11, 5, 20) and json.loads(r["source_raw_data"])["oprtId"] == 71


def test_day_slot(spark):
    r = slots.occurrences(payloads(spark, [DAY]), "DAY").first()
    assert r["source_occurrence_id"] == "R_1:2026-08-11:19:40:21:00"
    assert (r["available_count"], r["application_available"], r["fee"], r["is_free"]) == (0, False, None, None)


def test_bad_slots_are_rejected_row_by_row(spark):
    bad = [EXP | x for x in ({"rsvCnt": True}, {"rsvCnt": "9"}, {"rsvCnt": -1}, {"rsvCnt": 10}, {"aplyYn": "X"}, {"enTm": "09:00"}, {"stTm": None}, {"oprtId": None}, {"stTm": "25:00"})]
    got = slots.occurrences(payloads(spark, [EXP, *bad]), "EXP").orderBy("pos").collect()
    assert got[0]["error"] is None and all(r["error"] for r in got[1:]) and len(got) == 10


def test_payloads_that_are_no_array_of_objects(spark):
    got = slots.occurrences(payloads(spark, "{}", "not json", "[1]", "[]", None), "DAY").collect()
    assert sorted(r["error"] for r in got) == ["payload is not a JSON array"] * 3 + ["slot is not an object"]


LIST = """<section><ul class="img-board">
<li><div class="thumb"><img src="/pic/7.png"><span class="bd-label type1">곧 마감</span><span class="ico-wrap"><span class="ico">추첨</span></span></div>
<div class="con-box"><h4 class="tit"><a href="/show?tab=2&amp;rsrcUnqId=LEC_77x">도자기 &amp; 물레</a></h4><p class="place">북쪽 공방</p>
<ul class="info"><li>모집정원: 14</li><li>접수기간: 2026-03-02 ~ 2026-03-20</li><li>강좌기간: 2026-02-30 ~ 2026-04-01</li><li>이용료: 무료</li></ul></div></li>
<li><div class="con-box"><h4 class="tit">별 보는 밤</h4><ul class="info"><li>접수기간: 상시 접수</li><li>모집정원: 한 팀 세 명</li></ul><a href="http://stars.example.org/night?y=26">보기</a></div></li>
</ul></section><nav class="krds-pagination"><a href="?pageNo=4">4</a><a class="page-link active">5</a><a href="?pageNo=8">8</a><a href="?pageNo=6">6</a></nav>"""
DETAIL = """<main><div class="view-info"><input name="rsrcUnqId" value="LEC_77x"><div class="info-box"><div class="top"><h4 class="tit"> </h4><p>도자기와 물레</p><p class="place">시립 공방</p></div>
<ul class="cont"><li><span class="tit">접수현황</span><p>6 / 14</p></li><li><span class="tit">대상</span><p>청소년 만 나이 기준</p></li><li><span class="tit">요금</span><p>무료</p></li>
<li><span class="tit">접수기간</span><p>2026-03-02 10:00 ~ 2026-03-20 17:30</p></li></ul></div></div><div id="panel-1"><p>흙을 만집니다</p><p>보호자 동반</p></div>
<div id="panel-3"><div><p>지도</p></div><strong>주소</strong><span>-</span><p>강변길 30</p></div>
<div id="view_calendar"><button data-date="2026-04-03">3</button><button data-date="2026-04-04" disabled>4</button><button data-date="2026-04-03">3</button><button data-date="2026-04-31">?</button></div></main>"""
HOSTS, BASE = ("site.example.kr",), "https://site.example.kr/list"


def test_cards_and_pagination(spark):
    paging = [tuple(r["p"]) for r in spark.createDataFrame([(LIST, 5), (LIST, 4), ("", 1), (None, 1)], "h string, n int").select(html.pagination(F.coalesce("h", F.lit("")), F.col("n")).alias("p")).collect()]
    assert paging[0] == (True, 5, 6, None) and paging[1] == (True, 5, None, "expected page 4, found 5") and paging[2] == paging[3] == (False, None, None, None)
    assert html.with_cards(spark.createDataFrame([(None,)], "html string")).count() == 0
    items = normalize.list_items(html.with_cards(spark.createDataFrame([(5, LIST), (6, None)], "page int, html string")), HOSTS, BASE).orderBy("pos").collect()
    assert [(r["title"], r["resource_kind"], r["source_event_id"], r["capacity"]) for r in items] == [("도자기 & 물레", "LEC", "LEC_77x", 14), ("별 보는 밤", "external", None, None)]
    assert items[0]["registration_start"] == dt.date(2026, 3, 2) and items[0]["parse_error"] == "invalid date" and items[0]["is_free"] is True
    assert items[1]["capacity_text"] == "한 팀 세 명" and items[1]["registration_period_text"] == "상시 접수" and items[1]["registration_start"] is None


def test_normalized_events(spark):
    items = normalize.list_items(html.with_cards(spark.createDataFrame([(5, LIST)], "page int, html string")), HOSTS, BASE)
    found = normalize.details(html.with_details(spark.createDataFrame([(DETAIL,), ("<p>x</p>",)], "html string")))
    ev = {r["source_item_key"]: r for r in normalize.events(items, found, "F300").collect()}
    inside = ev["LEC_77x"]
    assert inside["registration_start"] == dt.datetime(2026, 3, 2, 1, 0) and inside["registration_start_date"] is None
    assert (inside["title"], inside["capacity"], inside["fee"], inside["address"], inside["detail_complete"]) == ("도자기와 물레", 14, 0, "강변길 30", True)
    assert inside["target_text"] == "청소년\n보호자 동반"
    outside = next(r for k, r in ev.items() if k.startswith("urlsha256:"))
    assert outside["detail_complete"] is True and outside["fee"] is None and outside["description"] is None
    assert [tuple(r) for r in normalize.occurrence_requests(found).collect()] == [("LEC_77x", dt.date(2026, 4, 3))]
    assert normalize.occurrence_requests(found, cap=0).count() == 0
    assert [tuple(r) for r in normalize.date_errors(found).collect()] == [("LEC_77x", "invalid active date")]
    odd = normalize.details(html.with_details(spark.createDataFrame([(DETAIL.replace("LEC_77x", "X-1"),), (DETAIL.replace('"cont"', '"other"'),)], "html string")))
    assert sorted(r["parse_error"] for r in odd.collect()) == ["invalid resource id", "no summary fields"]
    failed = {r["source_item_key"]: r for r in normalize.events(items, found.withColumn("parse_error", F.lit("invalid date")), "F300", keep=("page", "pos")).collect()}
    assert (failed["LEC_77x"]["detail_complete"], failed["LEC_77x"]["title"], failed["LEC_77x"]["page"], failed["LEC_77x"]["pos"]) == (False, "도자기 & 물레", 5, 0)
    asked = [("http://site.example.kr/show?rsrcUnqId=LEC_77x",), ("http://site.example.kr/show?rsrcUnqId=LEC_78",), ("http://site.example.kr/show?rsrcUnqId=EXP_77",), ("http://else.example/x",)]
    pages = spark.createDataFrame([(*u, DETAIL) for u in asked], "detail_url string, html string")
    guarded = normalize.details(html.with_details(pages), HOSTS)
    assert sorted((r["resource_id"], r["parse_error"] or "") for r in guarded.collect()) == [
        ("EXP_77", "expected a resource of kind EXP, found LEC_77x"), ("LEC_77x", ""), ("LEC_77x", "url of no resource"), ("LEC_78", "expected resource LEC_78, found LEC_77x"),
    ]
    capped = found.withColumn("active_dates", F.slice("active_dates", 1, 1))
    assert normalize.date_errors(capped).count() == 0 and normalize.date_errors(capped, 0).first()["error"] == "1 active dates, more than 0"
    assert tuple(normalize.summary(normalize.events(items, found, "F300")).first()) == (2, 1, 0, 0, 1, 0)


def test_broken_pages_prove_no_snapshot(spark):
    no_title = LIST.replace("별 보는 밤", " ")
    rows = [(1, 5, LIST), (2, 5, no_title), (3, 5, "<p>busy</p>"), (4, 5, '<ul class="img-board"></ul>'), (5, 1, LIST), (6, 5, None), (7, 5, LIST.replace("pageNo=6", "x=6"))]
    got = {r["run"]: r for r in html.page_rows(spark.createDataFrame(rows, "run int, page int, html string")).collect()}
    assert [(got[k]["list_count"], got[k]["error"]) for k in range(1, 8)] == [
        (2, None), (1, "card 2 has no title"), (0, "no card list"), (0, "empty card list"), (2, "expected page 1, found 5"), (0, "no card list"),
        (2, "pagination skips from page 5 to page 8"),
    ]
    pages = html.page_rows(spark.createDataFrame([(1, 1, LIST.split("<nav")[0]), (2, 1, no_title.split("<nav")[0]), (2, 2, LIST.split("<nav")[0])], "run int, page int, html string"))
    verdicts = {r["run"]: (r["status"], r["is_complete_snapshot"]) for r in runs.verdict(runs.chains(pages, ["run"], 12, 9), 12).collect()}
    assert verdicts == {1: ("success", True), 2: ("partial", False)}


def test_elements_balance_and_references_are_read(spark):
    page = """<!-- <div class="thumb">no</div> --><div data-x="a > b" class="big thumb">a<div>b &#44032;&#xAC01;&middot;<p>c</p></div><br>d &amp;lt;</div><p id="panel-1">e<script>var x = "<p>no</p>"</script></p><div class="thumb">no</div>"""
    df = spark.createDataFrame([(page,), ("<div class=thumb>open <b>end",), ("<i class='xthumb thumb-x'>no</i>",), (None,)], "h string")
    got = df.select(html.text_of(html.element(html.clean(F.col("h")), classes=("thumb",))["inner"], "|").alias("t"), html.text_of(html.element(html.clean(F.col("h")), ident="panel-1")["inner"]).alias("p")).collect()
    assert [tuple(r) for r in got] == [("a|b 가각·|c|d &lt;", "e"), ("open|end", None), (None, None), (None, None)]
    listed = df.select(html.items(F.lit("x<li>a<ul><li>b</li></ul><LI class=k>c<ol><li>d</ol></li>")).alias("i")).first()["i"]
    assert listed == ["<li>a<ul><li>b</li></ul>", "<LI class=k>c<ol><li>d</ol></li>"]


def test_very_long_pages(spark):
    card = '<li><a href="/x?rsrcUnqId=EXP_1"><h4 class="tit">t</h4></a><ul class="info"><li>k: v</li></ul></li>'
    long_ = f'<ul class="img-board">{card * 300}</ul>' + "<p title='>'>x</p>" * 20_000
    assert html.page_rows(spark.createDataFrame([(1, long_)], "page int, html string")).first()["list_count"] == 300
    wide = f'<div class="thumb" title="{"y" * 300_000}">z</div>'
    assert spark.createDataFrame([(wide,)], "h string").select(html.text_of(html.element(F.col("h"), classes=("thumb",))["inner"])).first()[0] == "z"


def test_links_and_titles(spark):
    page = """<head><TITLE lang=x> a &amp; <b </title></head><a class="k" href="/x?a=1&amp;b=2"><b>one</b> two</a><A HREF='y'>q</A><a href=z>r</a><a name="n">no</a><abbr>no</abbr>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    assert [(r["id"], r["pos"], r["href"], r["text"]) for r in html.with_links(df).orderBy("id", "pos").collect()] == [(1, 0, "/x?a=1&b=2", "one two"), (1, 1, "y", "q"), (1, 2, "z", "r")]
    assert {r["id"]: r["title"] for r in html.with_titles(df).collect()} == {1: "a & <b", 2: None, 3: None}


def test_landing(spark):
    rows = [(200, "[1]", True), (200, "{}", True), (503, "", True), (404, "x", False), (200, " ", False), (200, "접속 대기 중", False), (200, "<p>", False)]
    got = spark.createDataFrame(rows, "status int, body string, json boolean").select(landing.classify(F.col("status"), F.col("body"), F.col("json"))).collect()
    assert [r[0] for r in got] == ["ok", "malformed", "retry", "error", "empty", "blocked", "ok"]
    marked = spark.createDataFrame([("<ul class=img-board>", False), ("<p>", False), ("[1]", True)], "body string, json boolean").select(landing.classify(F.lit(200), F.col("body"), F.col("json"), "img-board"))
    assert [r[0] for r in marked.collect()] == ["ok", "malformed", "ok"]
    assert [r[0] for r in spark.range(2).select(landing.backoff_seconds(F.col("id"))).collect()] == [0.5, 1.0]
    jittered = [r[0] for r in spark.range(50).select(landing.backoff_seconds(F.lit(1), share=F.rand(1))).collect()]
    assert min(jittered) >= 1.0 and max(jittered) < 1.25 and len(set(jittered)) > 40
    asked = spark.createDataFrame([("retry", 0), ("retry", 1), ("retry", 2), ("error", 0), (None, 0)], "o string, n int").select(landing.asks_again(F.col("o"), F.col("n")))
    assert [r[0] for r in asked.collect()] == [True, True, False, False, False]


def test_unknown_endpoints_are_not_the_total(spark):
    got = landing.request_counts(spark.createDataFrame([("a",), ("a",), (None,)], "endpoint string")).collect()
    assert sorted((r["endpoint"] or "", r["n"]) for r in got) == [("", 1), ("a", 2), ("total", 3)]


def test_store_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert store.read(spark, path, "id long").count() == 0
    assert store.publish(spark.range(3), path) == 1 and store.publish(store.read(spark, path, "id long").where("id > 0"), path) == 2
    assert store.read(spark, path, "id long").count() == 2 and store.read(spark, path, "id long", 1).count() == 3


def test_one_writer_per_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert store.publish(spark.range(1), path) == 1
    (tmp_path / "t/_claims/2").touch()  # another writer's
    with pytest.raises(FileExistsError, match="version 2"):
        store.publish(spark.range(2), path)
    assert store.read(spark, path, "id long").count() == 1
    store.forget(spark, path)
    assert store.publish(spark.range(2), path) == 2
    with pytest.raises(Exception, match="by zero"):
        store.publish(spark.range(2).selectExpr("1 div (id - id) AS id"), path)
    assert store.publish(spark.range(3), path) == 3
