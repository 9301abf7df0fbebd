"""Words, entities, language and counts of text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def found(text: Column, pattern: str, group: int, cap: int) -> Column:
    """Distinct matches in order of their code points, cap at most."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))), 1, cap)


def emails(text: Column) -> Column:
    return found(text, K.EMAIL, 0, K.CAPS["emails"])


def phones(text: Column) -> Column:
    return found(text, K.PHONE, 0, K.CAPS["phones"])


def wechat(text: Column) -> Column:
    return found(text, "(?iu)" + K.WECHAT, 1, K.CAPS["wechat"])


def line_ids(text: Column) -> Column:
    return found(text, "(?iu)" + K.LINE, 1, K.CAPS["line_ids"])


def locations(text: Column) -> Column:
    """Names that the text holds, in the list's order."""
    low = F.lower(text)
    return F.slice(F.filter(F.array(*map(F.lit, K.LOCATIONS)), lambda x: F.contains(low, F.lower(x))), 1, K.CAPS["locations"])


def organizations(text: Column) -> Column:
    """A match for each suffix by itself: matches of different suffixes may overlap. Only suffixes that the text holds are
    searched with their pattern."""
    none = F.array().cast("array<string>")
    each = [F.when(F.contains(text, F.lit(s)), F.regexp_extract_all(text, F.lit(rf"{K.ORG_HEAD}\Q{s}\E"), F.lit(0))).when(text.isNotNull(), none) for s in K.ORG_SUFFIXES]
    return F.slice(F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*each)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))), 1, K.CAPS["organizations"])


def entities(text: Column) -> Column:
    return F.struct(
        emails(text).alias("emails"), phones(text).alias("phones"), wechat(text).alias("wechat"), line_ids(text).alias("line_ids"), locations(text).alias("locations"), organizations(text).alias("organizations")
    )


def language(text: Column) -> Column:
    """zh above 30 % Han characters, mixed above 5 %, else en; unknown without any character."""
    size = F.length(F.replace(text, F.lit(" "), F.lit("")))
    share = F.regexp_count(text, F.lit(K.HAN)) / size
    return F.when(F.coalesce(size, F.lit(0)) == 0, "unknown").when(share > 0.30, "zh").when(share > 0.05, "mixed").otherwise("en")


def has_contact(e: Column) -> Column:
    return (F.size(e["emails"]) > 0) | (F.size(e["phones"]) > 0) | (F.size(e["wechat"]) > 0)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(float(len(term)))


def cjk_share(text: Column) -> Column:
    size = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(size > 0, F.regexp_count(text, F.lit("[一-鿿぀-ヿ가-힣]")) / size).otherwise(0.0)


def first_region(query: Column, which: str) -> Column:
    """Region of the first key that the query holds; null if none."""
    low, out = F.lower(query), None
    for key, region in K.regions(which):
        out = F.when(F.contains(low, F.lit(key)), region) if out is None else out.when(F.contains(low, F.lit(key)), region)
    return out


def region_rank(query: Column, which: str) -> Column:
    """Place in the list of the first key that the query holds; null if none. The least of several queries is that of all."""
    low, out = F.lower(query), F
    for n, (key, _) in enumerate(K.regions(which)):
        out = out.when(F.contains(low, F.lit(key)), n)
    return out


def region_at(rank: Column, which: str) -> Column:
    return F.get(F.array(*[F.lit(region) for _, region in K.regions(which)]), rank)


def found_any(low: Column, names: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(low, n))
