import datetime as dt
import hashlib
import json
from decimal import Decimal
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from kalends.functions import hashing, period, strict, text, url


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = [tuple(v for _, v in values.values())] if values else [(1,)]
    return spark.createDataFrame(row, schema).select(column.alias("y")).first()["y"]


HOSTS = ("site.example.kr", "www.site.example.kr")


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTP://WWW.site.example.kr/a;jsessionid=AB12/b?q=1#f", "https://site.example.kr/a/b?q=1"),
    (" http://site.example.kr:8080/x ", "https://site.example.kr:8080/x"),
    ("http://site.example.kr:443/x", "https://site.example.kr/x"),
    ("HTTPS://Other.Example/P;JSESSIONID=1?a=;jsessionid=2", "https://Other.Example/P?a=;jsessionid=2"),
    (None, None),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, url.canonical(F.col("u"), HOSTS), u=("string", raw)) == want


@pytest.mark.parametrize("ref", ["b", "../b", "/b/./c/../d", "?q=1", "//h.example/x", "b/..", ".", "https://z.example/k", "b?x=../y", "../../../up"])
def test_relative_urls_resolve_like_the_standard(spark, ref):
    base = "https://site.example.kr/s/t/page.do?n=1"
    assert one(spark, url.resolved(F.col("u"), F.lit(base)), u=("string", ref)) == urljoin(base, ref)


def test_resource_needs_one_wellformed_id_on_an_own_host(spark):
    rows = [("https://site.example.kr/v?rsrcUnqId=EXP_01&mnu_code=F402",), ("https://site.example.kr/v?rsrcUnqId=EXP_01&rsrcUnqId=EXP_02",), ("https://x.example/v?rsrcUnqId=EXP_01",), ("https://site.example.kr/v?rsrcUnqId=BAD_01",)]
    kind, found = url.resource(F.col("u"), HOSTS)
    got = spark.createDataFrame(rows, "u string").select(kind, found, url.menu_code(F.col("u"), kind)).collect()
    assert [tuple(r) for r in got] == [("EXP", "EXP_01", "F402"), ("external", None, "F601"), ("external", None, "F601"), ("external", None, "F601")]


def test_text_uses_unicode_white_space(spark):
    assert one(spark, text.collapsed(F.col("t")), t=("string", "　a \t b \n c　")) == "a b \n c"
    assert one(spark, text.collapsed(F.col("t")), t=("string", "   ")) is None
    assert one(spark, text.unique_lines(F.col("t")), t=("string", "a  b\n\na b\nc")) == "a b\nc"


def test_label_values_last_wins(spark):
    assert one(spark, text.label_values(F.col("t")), t=("array<string>", ["a: 1", "b:2:3", "junk", "c:", "a:4"])) == {"a": "4", "b": "2:3"}


@pytest.mark.parametrize(("raw", "want"), [("12", 12), (" 7 ", 7), ("1,000", None), ("가족당 최대 4명", None), ("", None), (None, None), ("99999999999", None)])
def test_plain_integer(spark, raw, want):
    assert one(spark, text.plain_integer(F.col("t")), t=("string", raw)) == want


def test_target_lines_keep_open_sections_and_marked_lines(spark):
    told = "소개\n■ 참여 기준\n- 만 5세 이상\n■ 안내\n주차 가능\n유아 동반 가능\n- 만 5세 이상"
    assert one(spark, text.target_lines(F.col("t")), t=("string", told)) == "■ 참여 기준\n- 만 5세 이상\n유아 동반 가능"
    assert one(spark, text.target_lines(F.col("t")), t=("string", "없음")) is None


def test_small_text_rules(spark):
    assert one(spark, text.free_value(F.col("t")), t=("string", " 무 료")) is True
    assert one(spark, text.free_value(F.col("t")), t=("string", "유료")) is False
    assert one(spark, text.free_value(F.col("t")), t=("string", "1,000원")) is None
    assert one(spark, text.target_summary(F.col("t")), t=("string", "초등 1~3학년 만 나이 기준 ")) == "초등 1~3학년"
    assert one(spark, text.is_block_page(F.col("t")), t=("string", "<p>Access DENIED</p>")) is True
    assert one(spark, text.is_block_page(F.col("t")), t=("string", None)) is False


@pytest.mark.parametrize(("raw", "want"), [
    ("2026-08-01 ~ 2026-08-31", (dt.date(2026, 8, 1), dt.date(2026, 8, 31), None)), ("상시 2026-08-01 ~ 2026-08-31", (None, None, None)),
    ("2026-13-40 ~ 2026-12-01", (None, None, "invalid date")), ("미정", (None, None, None)), (None, (None, None, None)),
    ("2026-08-31~2026-08-01", (dt.date(2026, 8, 31), dt.date(2026, 8, 1), None)),
])
def test_date_range(spark, raw, want):
    assert tuple(one(spark, period.date_range(F.col("t")), t=("string", raw))) == want


def test_datetime_range_is_local_time(spark):
    got = one(spark, period.datetime_range(F.col("t")), t=("string", "2026-08-01 10:30 ~ 2026-08-01 12:00"))
    assert got["start"] == dt.datetime(2026, 8, 1, 1, 30) and got["error"] is None
    assert one(spark, period.datetime_range(F.col("t")), t=("string", "2026-08-01 12:00 ~ 2026-08-01 10:30"))["error"] == "end precedes start"


@pytest.mark.parametrize(("raw", "value", "bad"), [("5", 5, False), ("null", None, False), ('""', None, False), ("true", None, True), ('"40"', None, True), ("1.5", None, True), ("-1", None, True)])
def test_nonnegative_int_does_not_coerce(spark, raw, value, bad):
    got = one(spark, strict.nonnegative_int(F.try_parse_json(F.col("t")), "n"), t=("string", raw))
    assert (got["value"], got["error"] is not None) == (value, bad)


@pytest.mark.parametrize(("raw", "value", "bad"), [("0", 0, False), ('"12.5"', 12.5, False), ("null", None, False), ("true", None, True), ('"x"', None, True), ("-0.1", None, True)])
def test_decimal_takes_numeric_strings(spark, raw, value, bad):
    got = one(spark, strict.decimal(F.try_parse_json(F.col("t")), "fee"), t=("string", raw))
    assert (None if got["value"] is None else float(got["value"]), got["error"] is not None) == (value, bad)


def test_available_and_yes_no(spark):
    assert tuple(one(spark, strict.available(F.lit(40), F.lit(17)))) == (23, None)
    assert tuple(one(spark, strict.available(F.lit(None).cast("int"), F.lit(17)))) == (None, None)
    assert one(spark, strict.available(F.lit(1), F.lit(2)))["error"]
    assert [tuple(one(spark, strict.yes_no(F.try_parse_json(F.lit(v)), "a")))[0] for v in ('"Y"', '"N"', "null", '""')] == [True, False, None, None]
    assert one(spark, strict.yes_no(F.try_parse_json(F.lit('"X"')), "a"))["error"]


def test_content_hash_is_stable_json(spark):
    row = (dt.datetime(2026, 8, 1, 1, 30), dt.date(2026, 8, 1), Decimal("40000.00"), None, "가 \"x\"", [("b", Decimal("1.50"))])
    df = spark.createDataFrame([row], "at timestamp, day date, fee decimal(12,2), gone string, title string, kids array<struct<id:string,fee:decimal(12,2)>>")
    want = {"at": "2026-08-01T01:30:00+00:00", "day": "2026-08-01", "fee": "40000", "gone": None, "kids": [{"fee": "1.5", "id": "b"}], "title": "가 \"x\""}
    digest = hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(hashing.content_hash(df, df.columns)).first()[0] == digest
