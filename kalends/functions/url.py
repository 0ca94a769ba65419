"""URL expressions after RFC 3986, without UDFs. The reservation site's hosts are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: scheme, authority, path, query, fragment; each optional but the path.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SESSION = r"(?i);jsessionid=[^/?#&;]*"
RESOURCE_ID = r"^(LEC|EXP|DAY)_[A-Za-z0-9_]+$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def _has(url: Column, mark: str) -> Column:
    return url.rlike(mark)


def without_dots(path: Column) -> Column:
    """The path with `.` and `..` segments resolved."""
    segments = F.split(path, "/")
    last = F.get(segments, F.size(segments) - 1)

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(x == "..", up).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.concat(F.array_join(folded, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(url: Column, base: Column) -> Column:
    """A reference made absolute against a base with scheme and authority."""
    url = trimmed(url)
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_extract(_part(base, 3), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    path, query = _part(url, 3), F.when(_has(url, r"^[^#]*\?"), F.concat(F.lit("?"), _part(url, 4))).otherwise("")
    return (
        F.when(_part(url, 1) != "", url)
        .when(url.startswith("//"), F.concat(_part(base, 1), F.lit(":"), url))
        .when(url == "", base)
        .when(path == "", F.concat(root, _part(base, 3), F.when(query == "", F.when(_part(base, 4) != "", F.concat(F.lit("?"), _part(base, 4))).otherwise("")).otherwise(query)))
        .when(path.startswith("/"), F.concat(root, without_dots(path), query))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), query))
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), r"^.*@", ""), r":\d*$", ""))


def canonical(url: Column, hosts: tuple[str, ...] = (), base: Column | None = None) -> Column:
    """Absolute, scheme lower-case, no session path parameter, no fragment; the query as it is.

    The site's own hosts become https on the first of them and keep a port other than 443. Other authorities stay.
    """
    full = resolved(url, base) if base is not None else trimmed(url)
    scheme, netloc = F.lower(_part(full, 1)), _part(full, 2)
    if hosts:
        own, port = host(full).isin(*hosts), F.regexp_extract(netloc, r":(\d+)$", 1)
        netloc = F.when(own, F.concat(F.lit(hosts[0]), F.when((port != "") & (port != "443"), F.concat(F.lit(":"), port)).otherwise(""))).otherwise(netloc)
        scheme = F.when(own, "https").otherwise(scheme)
    path = F.regexp_replace(_part(full, 3), _SESSION, "")
    query = F.when(_part(full, 4) != "", F.concat(F.lit("?"), _part(full, 4))).otherwise("")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), path, query)


def query_values(url: Column, name: str) -> Column:
    """All non-empty values of a query parameter, in order, percent-decoded; what can't be decoded stays as it is."""
    fields = F.filter(F.split(_part(url, 4), "&"), lambda x: x.startswith(f"{name}=") & (F.length(x) > len(name) + 1))
    values = F.transform(fields, lambda x: F.substr(x, F.lit(len(name) + 2)))
    return F.transform(values, lambda x: F.coalesce(F.try_url_decode(x), x))


def resource(url: Column, hosts: tuple[str, ...], name: str = "rsrcUnqId") -> tuple[Column, Column]:
    """Kind and id of a reservation resource: exactly one well-formed id on an own host, else ("external", null)."""
    values = query_values(url, name)
    value = F.get(values, F.lit(0))
    fine = (F.size(values) == 1) & value.rlike(RESOURCE_ID) & host(url).isin(*hosts)
    return F.when(fine, F.regexp_extract(value, RESOURCE_ID, 1)).otherwise("external"), F.when(fine, value)


def item_key(event_id: Column, url: Column) -> Column:
    """The source-local key: the official id, else a digest of the canonical URL."""
    return F.coalesce(event_id, F.concat(F.lit("urlsha256:"), F.sha2(url, 256)))


def menu_code(url: Column, kind: Column, name: str = "mnu_code") -> Column:
    """The only menu code of the URL, else the kind's default (fixed values F401 and F601)."""
    values = query_values(url, name)
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.when(kind == "EXP", "F401").otherwise("F601"))
