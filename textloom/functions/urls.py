"""URL expressions: canonical form, registrable domain, crawlable predicate, priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v

HOST = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"
YEAR = r"/(19[0-9]{2}|20[0-9]{2})(?:[/-][0-9]{1,2})?(?:/|-|$)"


def _alternatives(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def host_of(url: Column) -> Column:
    """Authority without user and port, lower case."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """Dot segments of an absolute path resolved; those that lead above the root are dropped."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"[^/]/\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))


def resolve(base: Column, href: Column) -> Column:
    """An href against its page: absolute as it is; scheme-, root- and path-relative ones, dot segments resolved in the path."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(F.regexp_extract(path_of(base), r"^((?:/(?:[^/]*/)*)?)", 1), F.when(path_of(base).startswith("/"), F.lit("")).otherwise(F.lit("/")))
    page = F.regexp_replace(base, r"[?#].*$", "")
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(path == "", F.concat(page, rest))
        .otherwise(F.concat(root, without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), rest))
    )


def canonical(url: Column) -> Column:
    """The canonical URL, or null where the URL is not http(s) or its host is not a dotted name.

    The fragment goes, scheme and host are lower case, ports 80 and 443 go, slashes are collapsed, a
    trailing slash goes, and so do tracking parameters.
    """
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)", 1), r"^.*@", "")
    host, port = host_of(whole), F.regexp_extract(authority, r":([0-9]*)$", 1)
    place = F.when(port.isin("", "80", "443"), host).otherwise(F.concat(host, F.lit(":"), port))
    path = F.regexp_replace(path_of(whole), r"/{2,}", "/")
    path = F.when(path == "", F.lit("/")).when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(?:{_alternatives(v.TRACKING)})")), "&")
    built = F.concat(scheme, F.lit("://"), place, path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.when(scheme.isin("http", "https") & host.rlike(HOST), built)


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a suffix of two labels."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), r":.*$", ""), r"^www\.", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")
    return F.when(F.size(labels) <= 2, bare).when(last(2).isin(v.TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def crawlable(url: Column, allowed: list[str]) -> Column:
    """Allowed domain, no service host, no binary file, no off-topic path segment."""
    host, path = host_of(url), F.lower(path_of(url))
    return (
        registrable_domain(host).isin(allowed)
        & ~F.substring_index(host, ".", 1).isin(v.SERVICE_HOSTS)
        & ~path.rlike(f"(?:{_alternatives(v.BINARY_SUFFIXES)})$")
        & ~F.arrays_overlap(F.split(path, "[/_.-]+"), F.array(*map(F.lit, v.OFF_TOPIC)))
    )


def priority(url: Column, depth: Column, year: int) -> Column:
    """10 − 1.5·depth, +3 for fresh paths, a bonus or malus by the year in the path, −1 beyond seven slashes."""
    path = F.lower(path_of(url))
    found = F.regexp_extract(path, YEAR, 1)
    age = F.lit(year) - F.when(found != "", found).cast("int")
    by_year = F.when(found == "", F.lit(0.0)).when(age <= 1, F.lit(3.0)).otherwise(F.greatest(F.lit(-4.0), F.lit(-0.4) * age))
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    fresh = F.when(path.rlike(_alternatives(v.FRESH)), F.lit(3.0)).otherwise(F.lit(0.0))
    return F.lit(10.0) - F.lit(1.5) * depth + fresh + by_year - F.when(slashes > 7, F.lit(1.0)).otherwise(F.lit(0.0))
