"""Column expressions for URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, authority, path, query
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 4)


def query_values(url: Column, name: str) -> Column:
    """All non-empty values of one query parameter, in order."""
    return F.regexp_extract_all(F.concat(F.lit("&"), query(url)), F.lit(f"&{name}=([^&]+)"), F.lit(1))


def query_value(url: Column, name: str) -> Column:
    return F.get(query_values(url, name), F.lit(0))


def _glue(scheme_: Column, host_: Column, path_: Column, query_: Column) -> Column:
    return F.concat(
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""),
        F.when(host_ != "", F.concat(F.lit("//"), host_)).otherwise(""),
        path_,
        F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""),
    )


def normalized(url: Column) -> Column:
    """Same resource, one spelling: host in lower case, no fragment."""
    return _glue(scheme(url), host(url), path(url), query(url))


def _without_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segments = F.split(F.substr(p, F.lit(2)), "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.concat_ws("/", kept), tail)).otherwise(p)


def resolved(base: Column, href: Column) -> Column:
    """Absolute URL of a link found on the page at `base`."""
    frag = F.regexp_extract(href, r"(#.*)$", 1)
    h_path, h_query = path(href), query(href)
    origin = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, URL_PARTS, 2))
    base_path = F.when(path(base) == "", "/").otherwise(path(base))
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    with_query = F.when(h_query != "", F.concat(F.lit("?"), h_query)).otherwise("")
    base_query = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
    return (
        F.when(scheme(href) != "", href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(h_path), with_query, frag))
        .when(href.startswith("?"), F.concat(origin, path(base), with_query, frag))
        .when(href.startswith("#"), F.concat(origin, path(base), base_query, frag))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, h_path)), with_query, frag))
    )
