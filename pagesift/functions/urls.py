"""URL resolution as column expressions (RFC 3986 joining, as browsers and
Python's ``urljoin`` do for http/https pages).

Branches on the shape of the href; dot segments are folded with
``aggregate`` over the split path, so the whole thing stays JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import col_

SCHEME_RE = "^[a-zA-Z][a-zA-Z0-9+.-]*:"
BASE_SCHEME_RE = "^([a-zA-Z][a-zA-Z0-9+.-]*):"
BASE_NETLOC_RE = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
BASE_PATH_RE = "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
BASE_QUERY_RE = "^[^?#]*(\\?[^#]*)"
PATH_PART_RE = "^([^?#]*)"
SUFFIX_RE = "^[^?#]*(.*)$"


def _resolve(segs: Column) -> Column:
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.coalesce(F.element_at(segs, -1).isin(".", ".."), F.lit(False))
    folded = F.when(trailing, F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    path = F.array_join(folded, "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def url_join(base, href) -> Column:
    base, href = col_(base), col_(href)
    scheme = F.regexp_extract(base, BASE_SCHEME_RE, 1)
    netloc = F.regexp_extract(base, BASE_NETLOC_RE, 1)
    bpath = F.regexp_extract(base, BASE_PATH_RE, 1)
    bquery = F.regexp_extract(base, BASE_QUERY_RE, 1)
    origin = F.concat(scheme, F.lit("://"), netloc)
    hpath = F.regexp_extract(href, PATH_PART_RE, 1)
    suffix = F.regexp_extract(href, SUFFIX_RE, 1)

    base_parts = F.split(bpath, "/")
    base_parts = F.when(F.element_at(base_parts, -1) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(
        base_parts
    )
    merged = F.concat(base_parts, F.split(hpath, "/"))
    n = F.size(merged)
    merged = F.filter(merged, lambda x, i: (i == 0) | (i == n - 1) | (x != ""))
    segs = F.when(hpath.startswith("/"), F.split(hpath, "/")).otherwise(merged)

    return (
        F.when(href.isNull(), F.lit(None))
        .when(href == "", base)
        .when(href.rlike(SCHEME_RE), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(origin, bpath, bquery, href))
        .when(href.startswith("?"), F.concat(origin, bpath, href))
        .otherwise(F.concat(origin, _resolve(segs), suffix))
    )


def url_host(url) -> Column:
    return F.regexp_extract(col_(url), BASE_NETLOC_RE, 1)
