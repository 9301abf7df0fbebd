"""URL parts, normal form and predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def domain(url: Column) -> Column:
    """Authority with its port, as written."""
    return part(url, 2)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def plus_encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized(url: Column) -> Column:
    """Lower-case authority, no trailing slash, parameters, fragment or blank query values; query pairs decoded, sorted by
    key and value and encoded again."""
    path = F.regexp_replace(F.regexp_replace(part(url, 3), r";[^/]*$", ""), r"/+$", "")
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: F.regexp_like(p, F.lit("^[^=]*=.+$")))
    split = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    query = F.array_join(F.transform(F.array_sort(split), lambda s: F.concat(plus_encoded(s["k"]), F.lit("="), plus_encoded(s["v"]))), "&")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def any_in(x: Column, names: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(x, n))


def blocked(url: Column) -> Column:
    return any_in(host(url), K.BLOCKED)


def valid(url: Column) -> Column:
    """http or https, with an authority in which no skipped name stands, not even inside another."""
    return F.lower(part(url, 1)).isin("http", "https") & (domain(url) != "") & ~any_in(F.lower(domain(url)), K.SKIPPED)


def bare_domain(url: Column) -> Column:
    """Authority without the letters w and dots that it begins with."""
    return F.regexp_replace(domain(url), "^[w.]+", "")


def dotless(path: Column) -> Column:
    """A rooted path without its `.` and `..` segments: each `..` takes away the segment before it."""
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda have, x: F.when(x == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0)))).when(x == ".", have).otherwise(F.concat(have, F.array(x))))
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(F.regexp_like(path, F.lit(r"(^|/)\.{1,2}(/|$)")), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def joined(base: Column, href: Column) -> Column:
    """href seen from base, for the forms that links take: absolute, scheme-relative, rooted, query, fragment, relative."""
    scheme, root = F.concat(part(base, 1), F.lit("://")), F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    here = F.regexp_extract(base, r"^([^?#]*)", 1)
    rooted = lambda to: F.concat(root, dotless(F.regexp_extract(to, "^([^?#]*)", 1)), F.regexp_extract(to, "^[^?#]*(.*)$", 1))
    folder = F.regexp_replace(folder, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    return (
        F.when(F.regexp_like(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.rtrim(F.regexp_replace(scheme, "//$", "")), href))
        .when(F.startswith(href, F.lit("/")), rooted(href))
        .when(F.startswith(href, F.lit("?")), F.concat(here, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .when(href == "", base)
        .otherwise(rooted(F.concat(folder, F.lit("/"), href)))
    )
