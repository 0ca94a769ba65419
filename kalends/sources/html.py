"""Cards, pagination and details of listing pages, by column expressions over their HTML.

An element is found by the pattern of its opening tag and ends where tags of its own name balance; text is what stands
between tags. That is all these pages need, and it keeps rows in Spark: no page is handed to a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed

#: The rest of a tag behind its name; quoted values may hold `>`.
_REST = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
#: What stands before an attribute in its tag.
_BEFORE = r"""(?:[^>"']*?(?:"[^"]*+"|'[^']*+'))*?[^>"']*?"""
#: Named character references that pages use, beside &amp;, which comes last.
_NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "times": "×", "copy": "©",
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _opening(tag: str | None = None, classes: tuple[str, ...] = (), ident: str | None = None) -> str:
    """A pattern of an opening tag, its name captured."""
    looks = "".join(rf"""(?={_BEFORE}(?<![\w-])class\s*=\s*["']?[^"'>]*(?<![\w-]){c}(?![\w-]))""" for c in classes)
    if ident:
        looks += rf"""(?={_BEFORE}(?<![\w-])id\s*=\s*["']?{ident}(?![\w-]))"""
    return rf"<({tag or '[a-zA-Z][a-zA-Z0-9]*'})(?![\w-]){looks}{_REST}>"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in an opening tag, null if it isn't there."""
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def value(t: Column) -> Column:
        return F.when(t.rlike(rf"(?is)(?<![\w-]){name}\s*="), unescaped(F.concat(*(F.regexp_extract(t, pattern, k) for k in (1, 2, 3)))))

    return _let(tag, value)


def clean(html: Column) -> Column:
    """HTML without comments, scripts and styles; null is empty."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|\x01", "")


def element(html: Column, tag: str | None = None, classes: tuple[str, ...] = (), ident: str | None = None) -> Column:
    """Struct (inner, rest): what the first such element holds and what follows it; null if there is none.

    It ends where its own tag's openings and closings balance, or with the text.
    """
    pattern = "(?is)" + _opening(tag, classes, ident)

    def balanced(found: Column) -> Column:
        name, after = found["name"], found["after"]
        parts = F.split(after, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"(?![\w-]))")))
        opens, closes = (F.concat(F.lit(f"(?i)^<{mark}"), name, F.lit(r"(?![\w-])")) for mark in ("", "/"))

        def step(s: Column, x: Column) -> Column:
            depth = F.when(s["depth"] == 0, 0).when(F.regexp(x, closes), s["depth"] - 1).when(F.regexp(x, opens), s["depth"] + 1).otherwise(s["depth"])
            inside = depth > 0
            return F.struct(depth.alias("depth"), F.when(inside, F.concat(s["inner"], x)).otherwise(s["inner"]).alias("inner"), F.when(inside, s["rest"]).otherwise(F.concat(s["rest"], x)).alias("rest"))

        end = F.aggregate(parts, F.struct(F.lit(1).alias("depth"), F.lit("").alias("inner"), F.lit("").alias("rest")), step)
        return _let(end, lambda e: F.struct(e["inner"].alias("inner"), e["rest"].alias("rest")))

    def first(h: Column) -> Column:
        found = F.struct(F.regexp_extract(h, pattern, 1).alias("name"), F.regexp_extract(h, f"{pattern}(.*)", 2).alias("after"))
        return F.when(h.rlike(pattern), _let(found, balanced))

    return _let(html, first)


def items(html: Column) -> Column:
    """The HTML of each item of a list, whose inner HTML is given; items of lists within it stay inside theirs. An open item ends at the next."""

    def step(s: Column, x: Column) -> Column:
        lists = F.when(x.rlike(r"(?i)^<[uo]l\b"), 1).when(x.rlike(r"(?i)^</[uo]l\b"), -1).otherwise(0)
        mark = F.when((s["depth"] == 0) & x.rlike(r"(?i)^<li\b"), F.lit("\x01")).otherwise("")
        return F.struct((s["depth"] + lists).alias("depth"), F.concat(s["out"], mark, x).alias("out"))

    parts = F.split(html, r"(?i)(?=</?(?:ul|ol|li)\b)")
    marked = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step)["out"]
    return _let(F.split(marked, "\x01"), lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))


def text_of(html: Column, gap: str = " ") -> Column:
    """The texts between tags, each trimmed, with gap between them; null if there is none."""
    parts = F.filter(F.transform(F.split(html, rf"</?[a-zA-Z!]{_REST}>"), lambda x: F.regexp_replace(unescaped(x), r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return collapsed(F.array_join(parts, gap))


def _inner(html: Column, *how, gap: str = " ", **more) -> Column:
    return text_of(element(html, *how, **more)["inner"], gap)


def _cards(board: Column) -> Column:
    """The cards of a board's inner HTML: an array of structs, null where it is null."""

    def card(li: Column) -> Column:
        first = F.get(F.filter(F.regexp_extract_all(li, F.lit(rf"(?is)<a(?![\w-]){_REST}>"), F.lit(0)), lambda x: x.rlike(r"(?is)(?<![\w-])href\s*=")), F.lit(0))
        labels = F.filter(F.transform(items(F.coalesce(element(li, "ul", ("info",))["inner"], F.lit(""))), lambda x: text_of(x)), lambda x: x.isNotNull())

        def shown(thumb: Column) -> Column:
            image = F.get(F.filter(F.regexp_extract_all(thumb, F.lit(rf"(?is)<img(?![\w-]){_REST}>"), F.lit(0)), lambda x: x.rlike(r"(?is)(?<![\w-])src\s*=")), F.lit(0))
            kinds = {"status": ("bd-label", "type1"), "fee_type3": ("bd-label", "type3"), "fee_type4": ("bd-label", "type4"), "method": ("ico",)}
            return F.struct(_attribute(image, "src").alias("image"), *(_inner(thumb, None, c).alias(n) for n, c in kinds.items()))

        thumb = _let(element(li, classes=("thumb",))["inner"], shown)
        own = F.struct(_inner(li, "h4", ("tit",)).alias("title"), _inner(li, "p", ("place",)).alias("place"), F.trim(_attribute(first, "href")).alias("href"), labels.alias("labels"), thumb.alias("t"))
        shown_ = ("image", "status", "fee_type3", "fee_type4", "method")
        return _let(own, lambda o: F.struct(*(o[c].alias(c) for c in ("title", "place", "href", "labels")), *(o["t"][c].alias(c) for c in shown_)))

    return F.transform(items(board), card)


def _whole(card: Column) -> Column:
    return card["href"].isNotNull() & card["title"].isNotNull()


def _board(pages: DataFrame, column: str) -> Column:
    return element(clean(F.col(column)), "ul", ("img-board",))["inner"]


def with_cards(pages: DataFrame, column: str = "html") -> DataFrame:
    """A row per card that has a link and a title: the page's columns but the HTML, pos (from 0) and the card's fields."""
    keep = [c for c in pages.columns if c != column]
    whole = F.filter(_cards(_board(pages, column)), _whole)
    return pages.select(*keep, F.posexplode(whole).alias("pos", "card")).select(*keep, "pos", "card.*")


def pagination(html: Column, page: Column) -> Column:
    """Struct (detected, current, next_page, error): whether the page shows its place, the current number, and the least linked number
    above it; another current number than the page's own, and a next page further on than the following one, are errors."""
    page = page.cast("int")

    def read(bar: Column) -> Column:
        current = F.regexp_extract(F.coalesce(_inner(bar, None, ("page-link", "active")), F.lit("")), r"\d+", 0).try_cast("int")
        links = F.transform(F.regexp_extract_all(bar, F.lit(rf"(?is)<a(?![\w-]){_REST}>"), F.lit(0)), lambda a: F.regexp_extract(F.coalesce(_attribute(a, "href"), F.lit("")), r"[?&]pageNo=(\d+)", 1).try_cast("int"))
        return F.struct(current.alias("current"), F.array_min(F.filter(links, lambda n: n > page)).alias("next"))

    def told(r: Column) -> Column:
        other = F.coalesce(r["current"] != page, F.lit(False))
        number = lambda c: c.cast("string")
        error = F.when(other, F.concat(F.lit("expected page "), number(page), F.lit(", found "), number(r["current"]))).when(
            r["next"] > page + 1, F.concat(F.lit("pagination skips from page "), number(page), F.lit(" to page "), number(r["next"]))
        )
        return F.struct(r.isNotNull().alias("detected"), r["current"].alias("current"), F.when(~other, r["next"]).alias("next_page"), error.alias("error"))

    bar = element(html, classes=("krds-pagination",))["inner"]
    return _let(F.when(bar.isNotNull(), _let(bar, read)), told)


def page_rows(pages: DataFrame, page: str = "page", column: str = "html") -> DataFrame:
    """A row per list page for operators.runs.chains(): the page's columns but the HTML, list_count, next_page,
    pagination_detected, succeeded, detail_failures, error_count and error.

    A missing or empty card list, a card without link or title, a page number other than the page's own and a next page
    further on than the following one are errors; a page with an error did not succeed, so its run proves no complete snapshot. Its good
    cards still count. detail_failures is what operators.runs.with_issues() adds to.
    """
    keep = [c for c in pages.columns if c != column]
    read = pages.select(*keep, clean(F.col(column)).alias("_html"))
    read = read.select(*keep, _cards(element(F.col("_html"), "ul", ("img-board",))["inner"]).alias("_cards"), pagination(F.col("_html"), F.col(page)).alias("_paging"))
    broken = F.filter(
        F.transform("_cards", lambda c, i: F.when(~_whole(c), F.concat(F.lit("card "), (i + 1).cast("string"), F.when(c["href"].isNull(), " has no link").otherwise(" has no title")))), lambda x: x.isNotNull()
    )
    none = F.when(F.col("_cards").isNull(), F.array(F.lit("no card list"))).when(F.size("_cards") == 0, F.array(F.lit("empty card list"))).otherwise(broken)
    errors = F.array_compact(F.concat(none, F.array("_paging.error")))
    read = read.select(*keep, F.coalesce(F.size(F.filter("_cards", _whole)), F.lit(0)).alias("list_count"), "_paging", F.when(F.col("_cards").isNull(), 0).alias("_none"), errors.alias("_errors"))
    return read.select(
        *keep, F.when(F.col("_none") == 0, 0).otherwise(F.col("list_count")).alias("list_count"), F.col("_paging.next_page").alias("next_page"), F.col("_paging.detected").alias("pagination_detected"),
        (F.size("_errors") == 0).alias("succeeded"), F.lit(0).alias("detail_failures"), F.size("_errors").alias("error_count"), F.nullif(F.array_join("_errors", "; "), F.lit("")).alias("error"),
    )


def with_titles(pages: DataFrame, column: str = "html") -> DataFrame:
    """The page's columns but the HTML, and the text of its title element; null if there is none or it is blank."""
    raw = F.regexp_extract(column, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    keep = [c for c in pages.columns if c != column]
    return pages.select(*keep, collapsed(unescaped(raw)).alias("title"))


def with_links(pages: DataFrame, column: str = "html") -> DataFrame:
    """A row per anchor with an href: the page's columns but the HTML, pos (from 0), href and the anchor's text."""
    keep = [c for c in pages.columns if c != column]
    anchors = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(?is)<a\s[^>]*?href\s*=.*?</a>"), F.lit(0))
    found = pages.select(*keep, F.posexplode(anchors).alias("pos", "_a"))
    href = F.regexp_extract("_a", r"""(?is)^<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    value = F.regexp_replace(F.regexp_replace(href, r"(?is)^<a\s[^>]*?href\s*=\s*", ""), "^[\"']|[\"']$", "")
    inner = F.regexp_replace(F.regexp_replace("_a", r"(?is)^<a\s[^>]*>", ""), r"(?s)<[^>]*>", " ")
    return found.select(*keep, "pos", unescaped(value).alias("href"), collapsed(unescaped(inner)).alias("text"))


def unescaped(text) -> Column:
    """The text with numbered character references and the common named ones replaced, `&amp;` last."""

    def numbered(out: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"(?i)&#x?([0-9a-f]+);", 1)
        code = F.when(ref.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(fine, F.replace(out, ref, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(63)), 8, "0")), "UTF-32"))).otherwise(out)

    def by_number(t: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)))
        return F.when(t.contains("&#"), F.aggregate(refs, t, numbered)).otherwise(t)

    out = _let(F.col(text) if isinstance(text, str) else text, by_number)
    for name, plain in _NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(plain))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def with_details(pages: DataFrame, column: str = "html") -> DataFrame:
    """The page's columns but the HTML, and the fields of a reservation's detail page: resource_id, title, organizer, fields (a map), description,
    address and active_dates. Pages that are no detail have nulls; one whose summary is missing has no fields.
    """
    keep = [c for c in pages.columns if c != column]
    read = pages.select(*keep, clean(F.col(column)).alias("_html"))
    given = F.regexp_extract("_html", rf"""(?is)<input(?![\w-])(?={_BEFORE}(?<![\w-])name\s*=\s*["']?rsrcUnqId(?![\w-])){_REST}>""", 0)
    read = read.select(
        *keep, element(F.col("_html"), classes=("view-info",))["inner"].alias("_view"), F.when(given != "", F.coalesce(_attribute(given, "value"), F.lit(""))).alias("_id"),
        element(F.col("_html"), ident="panel-1")["inner"].alias("_about"), element(F.col("_html"), ident="panel-3")["inner"].alias("_map"), element(F.col("_html"), ident="view_calendar")["inner"].alias("_days"),
    )
    is_detail = F.col("_view").isNotNull() & F.col("_id").isNotNull()
    read = read.withColumns({"_top": element(F.col("_view"), classes=("top",))["inner"], "_list": element(F.col("_view"), "ul", ("cont",))["inner"]})
    read = read.withColumns({"_name": element(F.col("_top"), classes=("tit",)), "_pairs": F.transform(items(F.coalesce("_list", F.lit(""))), lambda li: F.struct(_inner(li, "span", ("tit",)).alias("k"), _inner(li, "p", gap="\n").alias("v")))})
    fine = F.filter("_pairs", lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    last = lambda pairs: F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    heading = r"(?is)<(?:h3|h4|strong)(?![\w-])[^>]*>\s*(?:<[^>]*>\s*)*주소\s*(?:<[^>]*>\s*)*</(?:h3|h4|strong)\s*>(.*)"
    days = F.filter(F.regexp_extract_all("_days", F.lit(rf"(?is)<button(?![\w-]){_REST}>"), F.lit(0)), lambda b: b.rlike(r"(?is)(?<![\w-])data-date\s*=") & ~b.rlike(r"""(?is)\sdisabled(?![\w-])"""))
    fields = {
        "resource_id": F.col("_id"), "title": F.coalesce(text_of(F.col("_name.inner")), _inner(F.col("_name.rest"), "p")), "organizer": _inner(F.col("_top"), None, ("place",)),
        "fields": F.map_from_entries(_let(fine, last)), "description": text_of(F.col("_about"), "\n"), "address": _inner(F.regexp_extract("_map", heading, 1), "p"),
        "active_dates": F.coalesce(F.array_distinct(F.transform(days, lambda b: _attribute(b, "data-date"))), F.array().cast("array<string>")),
    }
    return read.select(*keep, *(F.when(is_detail, v).alias(c) for c, v in fields.items()))
