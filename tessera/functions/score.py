"""The score of a page from 0 to 100: seven weighted components less penalties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from . import text as T


def terms(queries: list[str]) -> list[str]:
    """Lower-cased words of more than two characters, each once, in order."""
    return list(dict.fromkeys(w for q in queries for w in q.lower().split() if len(w) > 2))


def goal_limits(goal: int) -> tuple[int, float]:
    """The least score of a lead and the penalties' scale at an accuracy goal."""
    goal = max(0, min(100, goal))
    return int(goal * 0.35), 0.5 + goal / 100


def log_share(x: Column, full: float) -> Column:
    return F.log1p(x) / F.lit(math.log1p(full))


def keyword_freq(low: Column, n_words: Column, wanted: list[str], w: float) -> Column:
    if not wanted:
        return F.lit(0.0)
    hits = sum((T.occurrences(low, t) for t in wanted), F.lit(0.0))
    return F.when(n_words > 0, F.least(F.lit(float(w)), log_share(100 * (hits / n_words), 10) * w)).otherwise(0.0)


def semantic_cluster(low: Column, w: float, clusters: dict[str, list[str]] = K.CLUSTERS) -> Column:
    counts = [F.size(F.filter(F.array(*map(F.lit, words)), lambda x: F.contains(low, x))) for words in clusters.values()]
    hits = sum(counts, F.lit(0))
    matched = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    return F.when(hits > 0, F.least(F.lit(float(w)), (log_share(hits, 30) * 0.7 + matched / float(len(clusters)) * 0.3) * w)).otherwise(0.0)


def contact_presence(e: Column, w: float) -> Column:
    one = lambda c: F.when(c, w / 4).otherwise(0.0)
    return one(F.size(e["emails"]) > 0) + one(F.size(e["phones"]) > 0) + one(F.size(e["wechat"]) > 0) + one((F.size(e["line_ids"]) > 0) | (F.size(e["organizations"]) > 0))


def content_length(n: Column, w: float) -> Column:
    return F.when(n < 50, 0.0).when(n <= 3000, log_share(n, 3000) * w).otherwise((1 - F.least(F.lit(0.2), (n - 3000) / 50000.0)) * w)


def multilingual(lang: Column, w: float) -> Column:
    return F.when(lang == "mixed", float(w)).when(lang == "zh", w / 2).otherwise(0.0)


def metadata_quality(meta: Column, n_schema: Column, w: float) -> Column:
    get = lambda k: F.coalesce(F.element_at(meta, F.lit(k)), F.lit(""))
    one = lambda c: F.when(c, w / 4).otherwise(0.0)
    return one((get("og:title") != "") | (get("og:description") != "")) + one(F.length(get("description")) > 20) + one(n_schema > 0) + one(get("og:image") != "")


def link_authority(inbound: Column, w: float) -> Column:
    return F.least(F.lit(float(w)), log_share(inbound, 50) * w)


def penalties(n_words: Column, n_headings: Column, top_word: Column, n_capped: Column, n_meta: Column) -> Column:
    """Thin text 20, no heading 5, a word above 5 % of the text 15, no metadata 3."""
    one = lambda c, x: F.when(c, float(x)).otherwise(0.0)
    return one(n_words < 50, 20) + one(n_headings == 0, 5) + one((n_capped > 0) & (top_word / n_capped > 0.05), 15) + one(n_meta == 0, 3)


def stuffing(text: Column, cap: int = 50_000) -> Column:
    """n_capped and top_word: words of the capped text and how often its most frequent word stands in it.

    Worked out in the row: the words are sorted, and the longest run of one word counts. Nothing is shuffled.
    """
    w = F.array_sort(T.words(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, cap))))
    begin = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(s, x):
        run = F.when(s["word"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("word"), run.alias("run"), F.greatest(s["top"], run).alias("top"))

    return F.struct(F.size(w).cast("bigint").alias("n_capped"), F.aggregate(w, begin, step, lambda s: s["top"]).cast("bigint").alias("top_word"))


def top_words(pages: DataFrame, key: str, text: str, cap: int = 50_000) -> DataFrame:
    """key, n_capped, top_word of the rows that have any word."""
    rows = pages.select(key, stuffing(F.col(text), cap).alias("s"))
    return rows.filter("s.n_capped > 0").select(key, "s.n_capped", "s.top_word")


def scored(pages: DataFrame, wanted: list[str], mode: str, goal: int = 50, clusters: dict[str, list[str]] = K.CLUSTERS) -> DataFrame:
    """pages with the components, penalties and total.

    Needs the columns main_text, title, word_count, headings, language, metadata, schema_org, entities and inbound.
    """
    w = dict(zip(K.COMPONENTS, K.WEIGHTS[mode], strict=True))
    scale = goal_limits(goal)[1]
    both = F.lower(F.concat(F.col("main_text"), F.lit(" "), F.col("title")))
    n = F.col("word_count")
    parts = {
        "keyword_freq": keyword_freq(both, n, wanted, w["keyword_freq"]), "semantic_cluster": semantic_cluster(both, w["semantic_cluster"], clusters),
        "contact_presence": contact_presence(F.col("entities"), w["contact_presence"]), "content_length": content_length(n, w["content_length"]),
        "multilingual": multilingual(F.col("language"), w["multilingual"]), "metadata_quality": metadata_quality(F.col("metadata"), F.size("schema_org"), w["metadata_quality"]),
        "link_authority": link_authority(F.col("inbound"), w["link_authority"]),
    }
    out = pages.withColumns(parts).withColumn("stuffing", stuffing(F.col("main_text")))
    fault = penalties(n, F.size("headings"), F.col("stuffing.top_word"), F.col("stuffing.n_capped"), F.size(F.map_keys("metadata"))) * scale
    raw = F.lit(0.0)
    for c in K.COMPONENTS:
        raw = raw + F.col(c)
    total = F.greatest(F.lit(0), F.least(F.lit(100), (raw - F.col("fault")).cast("int")))
    return out.withColumn("fault", fault).withColumn("total", total).withColumn("penalties", -F.bround("fault", 1)).drop("fault", "stuffing")
