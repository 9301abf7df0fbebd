"""Technology of a site from its response headers (a map with lower-case keys) and html, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def held(x: Column, signs: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(x, s))


def all_named(x: Column, table: dict[str, list[str]]) -> Column:
    """Names of the table, in order, of which a sign is held."""
    return F.array_compact(F.array(*[F.when(held(x, signs), F.lit(name)) for name, signs in table.items()]))


def first_named(x: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(held(x, signs), F.lit(name)) for name, signs in table.items()])


def header(h: Column, name: str) -> Column:
    return F.coalesce(F.element_at(h, F.lit(name)), F.lit(""))


def server(h: Column) -> Column:
    both = F.lower(F.concat_ws(" ", header(h, "server"), header(h, "x-powered-by")))
    raw = header(h, "server")
    return F.coalesce(*[F.when(F.contains(both, F.lit(s)), F.lit(n)) for s, n in K.SERVERS.items()], F.when(raw != "", F.trim(F.split(raw, "/")[0])))


def cms(h: Column, html: Column) -> Column:
    names = {n: [n.lower()] for n in K.CMS}
    return F.coalesce(first_named(F.lower(header(h, "x-generator")), names), first_named(F.lower(F.regexp_extract(html, "(?i)" + K.GENERATOR, 1)), names), first_named(html, K.CMS))


def framework(html: Column) -> Column:
    """Signs are lower-case and the html is not lowered."""
    return first_named(html, K.FRAMEWORKS)


def cdn(h: Column) -> Column:
    via = F.lower(header(h, "via"))
    by_via = F.when(F.contains(via, F.lit("cloudfront")), "AWS CloudFront").when(F.contains(via, F.lit("varnish")), "Varnish")
    return F.coalesce(*[F.when(F.map_contains_key(h, F.lit(k)), F.lit(n) if n else by_via) for k, n in K.CDN_HEADERS])


def analytics(html: Column) -> Column:
    return all_named(html, K.ANALYTICS)


def security(h: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, K.SECURITY_HEADERS)), F.map_keys(h))


def server_language(h: Column, html: Column) -> Column:
    powered = F.lower(header(h, "x-powered-by"))
    form = F.when(F.regexp_like(html, F.lit(r"""(?i)action=["'][^"']*\.php""")), "PHP").when(F.regexp_like(html, F.lit(r"""(?i)action=["'][^"']*\.asp""")), "ASP.NET")
    return F.coalesce(*[F.when(F.contains(powered, F.lit(s)), F.lit(n)) for s, n in K.SERVER_LANGUAGES.items()], form)


def kept_headers(h: Column) -> Column:
    return F.map_filter(h, lambda k, _: k.isin(K.KEPT_HEADERS))


def fingerprint(headers: Column, html: Column) -> Column:
    """All of it in one struct; html counts up to 100,000 characters."""
    h, x = F.transform_keys(headers, lambda k, _: F.lower(k)), F.substring(html, 1, 100_000)
    return F.struct(
        server(h).alias("server"), cms(h, x).alias("cms"), framework(x).alias("framework"), cdn(h).alias("cdn"), analytics(x).alias("analytics"), security(h).alias("security_headers"),
        server_language(h, x).alias("server_language"), kept_headers(h).alias("headers"),
    )
