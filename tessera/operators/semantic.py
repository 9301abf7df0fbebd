"""Concepts of queries by an inverted index over a vocabulary, and the expansion of queries.

A vocabulary is a table of concepts (concept, domain, synonyms) and one of translations (concept, lang, terms). VOCABULARY
is a small one of this library's own; callers bring theirs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

VOCABULARY = [
    ("football", "sports", ["football", "soccer"]), ("sports_academy", "sports", ["sports academy", "academy"]), ("hotel", "travel", ["hotel", "resort", "guest house"]),
    ("logistics", "logistics", ["logistics", "freight forwarding", "shipping"]), ("university", "education", ["university", "college"]), ("restaurant", "food", ["restaurant", "catering"]),
    ("contact", "business", ["contact details", "contact"]),
]
TRANSLATIONS = [
    ("football", "zh", ["足球"]), ("football", "de", ["Fußball"]), ("football", "fr", ["football"]), ("football", "es", ["fútbol"]), ("sports_academy", "zh", ["体育学院", "运动学院"]),
    ("sports_academy", "de", ["Sportakademie"]), ("hotel", "zh", ["酒店"]), ("hotel", "de", ["Hotel", "Ferienanlage"]), ("hotel", "th", ["โรงแรม"]), ("logistics", "zh", ["物流"]), ("logistics", "de", ["Logistik"]),
]


def ends(word: str, suffixes: list[str], least: int = 0) -> str | None:
    """The first of the suffixes that the word ends with and that leaves so many letters before it."""
    return next((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= least), None)


def mended(word: str) -> str:
    """What is left of a word when -ed or -ing goes: at, bl and iz get their e back, a doubled letter becomes one."""
    if word.endswith(K.STEM_MENDED):
        return word + "e"
    return word[:-1] if len(word) > 1 and word[-1] == word[-2] and word[-1] not in K.STEM_DOUBLED else word


def stem(word: str) -> str:
    """A light Porter stemmer: plural and -ed/-ing endings, two rounds of derivations, one ending of the last list."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if found := ends(w, list(K.STEM_PLURALS)):
        w = w.removesuffix(found) + K.STEM_PLURALS[found]
    found = ends(w, K.STEM_PAST)
    if found == "eed":
        w = w[:-1] if len(w) > 4 else w
    elif found and set(w.removesuffix(found)) & set("aeiou"):
        w = mended(w.removesuffix(found))
    for table, least in ((K.STEM_DERIVED, 2), (K.STEM_ADJECTIVES, 1)):
        if found := ends(w, list(table), least):
            w = w.removesuffix(found) + table[found]
    found = ends(w, K.STEM_LAST)
    rest = w.removesuffix(found) if found else ""
    return rest if len(rest) > 1 and (found != "ion" or rest[-1] in "st") else w


def index(spark: SparkSession, vocabulary=VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Token weights (token, concept, domain, tenths, seq) and phrases (phrase, concept, domain, seq), longest first.

    Weights are in tenths, so that their sums do not depend on their order.
    """
    tokens, phrases = [], []
    for concept, domain, synonyms in vocabulary:
        for s in synonyms:
            parts = re.findall("[a-z0-9]+", s.lower())
            tokens += [(stem(p), concept, domain, 10 if len(parts) == 1 else 8) for p in parts]
            if len(parts) > 1:
                phrases.append(("_".join(parts), concept, domain))
    phrases.sort(key=lambda p: -len(p[0]))
    t = spark.createDataFrame([(*x, len(phrases) + i) for i, x in enumerate(tokens)], "token string, concept string, domain string, tenths int, seq int")
    p = spark.createDataFrame([(*x, i) for i, x in enumerate(phrases)] or [], "phrase string, concept string, domain string, seq int")
    return t, p


def index_of(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of a table (pos, concept, domain, synonyms); pos orders the concepts, of which there may be 2^18."""
    one = vocabulary.select("pos", "concept", "domain", F.posexplode("synonyms").alias("at", "synonym"))
    one = one.withColumn("parts", F.regexp_extract_all(F.lower("synonym"), F.lit("[a-z0-9]+"), F.lit(0)))
    each = one.select("pos", "concept", "domain", "at", F.when(F.size("parts") == 1, 10).otherwise(8).alias("tenths"), F.posexplode("parts").alias("k", "word"))
    seq = F.col("pos").cast("bigint") * (1 << 16) + F.col("at") * 256 + F.col("k")
    tokens = stems(each, "word").select(F.col("stem").alias("token"), "concept", "domain", "tenths", seq.alias("seq"))
    phrase = F.array_join("parts", "_")
    longest_first = (F.lit(1 << 12) - F.least(F.length(phrase), F.lit(4095))).cast("bigint") * (1 << 26) + F.col("pos") * 256 + F.col("at")
    return tokens, one.filter(F.size("parts") > 1).select(phrase.alias("phrase"), "concept", "domain", longest_first.alias("seq"))


def swapped(w, table: dict[str, str], least: int = 0):
    """A word with the first of the suffixes that leaves so many letters before it exchanged."""
    out = F
    for end, new in table.items():
        out = out.when(F.endswith(w, F.lit(end)) & (F.length(w) >= len(end) + least), F.concat(F.left(w, F.length(w) - len(end)), F.lit(new)))
    return out.otherwise(w)


def let(value, f):
    """f of a value that is worked out once, and that no rule of the optimizer writes out again."""
    return F.transform(F.array(value), f)[0]


def unpast(w):
    """A word without -ed or -ing after a vowel, mended; -eed loses its last letter."""
    past = F.when(F.endswith(w, F.lit("eed")), F.lit(None).cast("string"))
    for end in K.STEM_PAST[1:]:
        rest = F.left(w, F.length(w) - len(end))
        past = past.when(F.endswith(w, F.lit(end)) & F.regexp_like(rest, F.lit("[aeiou]")), rest)

    def mend(r):
        last, before = F.substring(r, -1, 1), F.substring(F.left(r, F.length(r) - 1), -1, 1)
        doubled = (F.length(r) > 1) & (last == before) & ~F.contains(F.lit(K.STEM_DOUBLED), last)
        again = F.when(F.regexp_like(r, F.lit(f"({'|'.join(K.STEM_MENDED)})$")), F.concat(r, F.lit("e"))).when(doubled, F.left(r, F.length(r) - 1)).otherwise(r)
        return F.when(r.isNotNull(), again).when(F.endswith(w, F.lit("eed")) & (F.length(w) > 4), F.left(w, F.length(w) - 1)).otherwise(w)

    return let(past, mend)


def unended(w):
    """A word without the first of the last list's endings that it has, if enough is left."""
    out = F
    for end in K.STEM_LAST:
        enough = F.length(w) > len(end) + 1
        out = out.when(F.endswith(w, F.lit(end)), F.when(enough & F.regexp_like(w, F.lit("[st]ion$")) if end == "ion" else enough, F.left(w, F.length(w) - len(end))).otherwise(w))
    return out.otherwise(w)


def stems(tokens: DataFrame, column: str) -> DataFrame:
    """Adds the stem of each word of a column: stem() as built-ins, each step once."""
    plural = let(F.lower(column), lambda w: swapped(w, K.STEM_PLURALS))
    derived = let(let(plural, unpast), lambda w: swapped(w, K.STEM_DERIVED, 2))
    done = let(let(derived, lambda w: swapped(w, K.STEM_ADJECTIVES, 1)), unended)
    return tokens.withColumn("stem", F.when(F.length(column) <= 2, F.lower(column)).otherwise(done))


def concepts(queries: DataFrame, tokens: DataFrame, phrases: DataFrame, key: str = "query_id", query: str = "query", top: int = 8, stemmed: bool = True) -> DataFrame:
    """key, concept, domain, tenths, rank: the top concepts of each query. The phrases, which are looked for inside the joined words, are
    broadcast: a vocabulary is the caller's, of some thousand rows. Tokens and translations are joined by size.

    A phrase that the joined words hold adds 20 tenths, each word its weights. Ties go to what was met first: phrases from
    the longest, then words in the query's order.
    """
    low = F.regexp_extract_all(F.lower(F.col(query)), F.lit("[a-z0-9]+"), F.lit(0))
    words = queries.select(key, low.alias("w"))
    joined = words.select(key, F.array_join("w", "_").alias("all"))
    by_phrase = joined.join(F.broadcast(phrases), F.contains(F.col("all"), F.col("phrase"))).select(key, "concept", "domain", F.lit(20).alias("tenths"), F.col("seq").cast("bigint").alias("seen"))
    each = words.select(key, F.posexplode("w").alias("pos", "word")).filter("length(word) > 2")
    each = stems(each, "word") if stemmed else each.withColumn("stem", F.col("word"))
    by_word = each.join(tokens, F.col("stem") == F.col("token")).select(key, "concept", "domain", "tenths", (F.lit(1 << 40) + F.col("pos").cast("bigint") * (1 << 40) + F.col("seq")).alias("seen"))
    sums = by_phrase.unionByName(by_word).groupBy(key, "concept", "domain").agg(F.sum("tenths").alias("tenths"), F.min("seen").alias("seen"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("tenths"), "seen"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= top)


def domains(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """key, domain, tenths, rank: sums over the top concepts; rank 1 is the primary domain."""
    sums = ranked.groupBy(key, "domain").agg(F.sum("tenths").alias("tenths"), F.min("rank").alias("first"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("tenths"), "first"))).drop("first")


def translations(ranked: DataFrame, table: DataFrame, key: str = "query_id") -> DataFrame:
    """key, lang, terms: distinct terms of the top concepts in their order. table: concept, lang, terms."""
    rows = ranked.join(table, "concept").groupBy(key, "lang").agg(F.array_sort(F.collect_list(F.struct("rank", "terms"))).alias("x"))  # eight concepts at most
    return rows.select(key, "lang", F.array_distinct(F.flatten(F.col("x.terms"))).alias("terms"))


def native_query(terms, lang, mode: str):
    """Up to four terms; without spaces in Chinese, Japanese and Korean, where lead queries in Chinese ask for contacts."""
    some = F.slice(terms, 1, 4)
    cjk, chinese = lang.isin("zh", "zh_tw", "ja", "ko"), lang.isin("zh", "zh_tw")
    packed = F.array_join(some, "")
    asks = F.contains(packed, F.lit("联系")) | F.contains(packed, F.lit("聯絡"))
    packed = F.when(chinese & ~asks, F.concat(packed, F.lit(" 联系方式"))).otherwise(packed) if mode == "leadgen" else packed
    return F.when(F.size(terms) > 0, F.when(cjk, packed).otherwise(F.array_join(some, " ")))


def active_languages(query, region, forced: list[str] | None = None):
    """Forced languages, or Chinese for a CJK query, or the region's; in Europe those of the countries named, else three."""
    if forced:
        return F.array(*map(F.lit, forced))
    low = F.lower(query)
    none = F.array().cast("array<string>")
    named = F.array_compact(F.array(*[F.when(T.found_any(low, names), F.lit(lang)) for lang, names in K.EUROPE_LANGS.items()]))
    europe = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("de"), F.lit("fr"), F.lit("es")))
    out = F.when(T.cjk_share(query) > 0.25, F.array(F.lit("zh"))).when(region == "europe", europe)
    for r, langs in K.AUTO_LANGS.items():
        if r != "europe":
            out = out.when(region == r, F.array(*map(F.lit, langs)))
    return out.otherwise(none)


def expand(queries: DataFrame, tokens: DataFrame, phrases: DataFrame, table: DataFrame, mode: str = "leadgen", forced: list[str] | None = None, key: str = "query_id", query: str = "query", cap: int = 15) -> DataFrame:
    """key, pos, expanded: the query and its variants, each once, in order: cities, suffixes, native queries."""
    ranked = concepts(queries, tokens, phrases, key, query)
    primary = domains(ranked, key).filter("rank = 1").select(key, F.col("domain").alias("primary"))
    terms = translations(ranked, table, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", "terms"))).alias("by_lang"))  # one entry a language
    q = queries.select(key, F.trim(query).alias("q")).join(primary, key, "left").join(terms, key, "left").withColumn("region", T.first_region(F.col("q"), "expand"))
    low, plus = F.lower("q"), lambda s: F.concat(F.col("q"), F.lit(" "), s)
    pick = lambda table_, default: F.coalesce(*[F.when(F.col("primary") == d, F.array(*map(F.lit, s[:2]))) for d, s in table_.items()], F.array(F.lit(default)))
    none = F.array().cast("array<string>")
    if mode == "leadgen":
        cities = F.coalesce(*[F.when(F.col("region") == r, F.array(*map(F.lit, c))) for r, c in K.CITIES.items() if c], none)
        english = F.concat(F.transform(F.filter(cities, lambda c: ~F.contains(low, F.lower(c))), plus), F.transform(pick(K.SUFFIXES["leadgen"], "contact email"), plus))
    elif mode == "research":
        places = F.when(F.col("region").isNull(), F.array(F.lit(K.RESEARCH_NOWHERE))).when(F.col("region") == "china", F.array(F.lit(K.RESEARCH_CHINA)))
        for r, names in K.RESEARCH_REGIONS.items():
            places = places.when(F.col("region") == r, F.filter(F.array(*map(F.lit, names)), lambda c: ~F.contains(low, F.lower(c))))
        english = F.concat(F.transform(pick(K.SUFFIXES["research"], "industry market report"), plus), F.array(plus(F.lit("association directory"))), F.transform(places.otherwise(none), plus))
    else:
        english = F.array(plus(F.lit("official site")), plus(F.lit("about contact")))
    langs = active_languages(F.col("q"), F.col("region"), forced)

    def variants(lang):
        found = F.slice(F.coalesce(F.try_element_at(F.col("by_lang"), lang), none), 1, 5)
        native = native_query(found, lang, mode)
        words = F.split(native, " ")
        extra = F.slice(F.filter(found, lambda t: ~F.array_contains(words, t) & (F.length(t) > 2)), 1, 2)
        again = F.when(~lang.isin("zh", "zh_tw", "ja", "ko") & (F.size(extra) > 0), F.concat(native, F.lit(" "), F.array_join(extra, " ")))
        return F.when(native.isNull(), none).otherwise(F.array_compact(F.array(native, again)))

    every = F.concat(F.array(F.col("q")), english, F.flatten(F.transform(langs, variants)))
    kept = F.slice(F.array_distinct(F.filter(F.transform(every, F.trim), lambda s: s != "")), 1, cap)
    return q.select(key, F.posexplode(kept).alias("pos", "expanded"))


def picked(queries: DataFrame, key: str = "job_id", query: str = "query", pos: str = "pos") -> DataFrame:
    """Queries to search with: the three shortest without CJK by length and order, then the first two with; five at most."""
    cjk = T.cjk_share(F.col(query)) > 0.25
    rank = F.row_number().over(W.partitionBy(key, "cjk").orderBy(F.when(F.col("cjk"), 0).otherwise(F.length(query)), pos))
    return queries.withColumn("cjk", cjk).withColumn("rank", rank).filter((~F.col("cjk") & (F.col("rank") <= 3)) | (F.col("cjk") & (F.col("rank") <= 2))).select(key, query, "cjk", "rank")


def fallback_seeds(queries: DataFrame, seeds: DataFrame, known: DataFrame, key: str = "job_id", query: str = "query") -> DataFrame:
    """key, url: seeds (topic, region, url; broadcast, the caller's) whose topic one of the queries holds and whose region is
    that of the queries or none, without those known.

    The region is that of the first key in the list that any of the queries holds. Queries are looked at one by one, so a
    job may have any number of them.
    """
    region = queries.groupBy(key).agg(F.min(T.region_rank(F.col(query), "search")).alias("rank")).select(key, F.coalesce(T.region_at(F.col("rank"), "search"), F.lit("")).alias("region_of"))
    hit = queries.select(key, F.lower(query).alias("low")).join(F.broadcast(seeds), F.contains(F.col("low"), F.col("topic"))).select(key, "region", "url").distinct()
    near = hit.join(region, key).filter((F.col("region") == "") | (F.col("region") == F.col("region_of")))
    return near.select(key, "url").distinct().join(known.select(key, "url"), [key, "url"], "left_anti")
