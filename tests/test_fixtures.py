"""Golden cases of URLs, entities, pages, scores, graphs, expansion and fingerprints."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import fingerprint as FP
from tessera.functions import score as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import graph as G
from tessera.operators import html as H
from tessera.operators import semantic as A
from tessera.plans import discovery, jobs, pipeline, store
from tessera.sources import fetch as fetching
from tessera.streaming import ingest


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.COM:443/a//?b=2&a=1&a=0#f", "https://ex.com:443/a?a=0&a=1&b=2"), ("http://ex.com", "http://ex.com/"), ("http://ex.com/p;v=1?x=&y=a+b%2Fc", "http://ex.com/p?y=a+b%2Fc"),
        ("http://ex.com/A/", "http://ex.com/A"), (None, None),
    ],
)
def test_normalized(spark, url, want):
    assert one(spark, url, U.normalized) == want


def test_url_predicates(spark):
    assert [one(spark, u, U.valid) for u in ("https://eurobasket.com", "https://www.eurosport.com", "ftp://a.b", "https://", "https://ok.example/x")] == [False, False, False, False, True]
    assert one(spark, "https://wework.com/x", U.bare_domain) == "ework.com"
    df = spark.createDataFrame([(f"https://h.example/{i}",) for i in range(7)], "url string")
    assert [G.domain_cap(df, c).count() for c in (5, 8)] == [5, 7]


def test_joined(spark):
    cases = {"/n": "https://h.example/n", "?a=1": "https://h.example/d/p?a=1", "//o.example/z": "https://o.example/z", "q": "https://h.example/d/q", "https://x.example/": "https://x.example/", "#t": "https://h.example/d/p?k=1#t", "../x": "https://h.example/x", "./y?u=a/../b": "https://h.example/d/y?u=a/../b", "/a/./b/../c": "https://h.example/a/c", "/a/..": "https://h.example/", "/../../z": "https://h.example/z", "a/b/.": "https://h.example/d/a/b/"}
    got = {h: spark.createDataFrame([("https://h.example/d/p?k=1", h)], "b string, h string").select(U.joined(F.col("b"), F.col("h")).alias("y")).first().y for h in cases}
    assert got == cases


def test_entities(spark):
    text = "Write to a.b@c-d.co.th, a.b@c-d.co.th. Tel +66 2 1234 5678 or (415) 555-2671; card 4111111111111111. 微信号：abc_12345 WX zzz headline id foo. Visit Acme Trading Ltd. and Beta Group in Bangkok, 泰国"
    e = one(spark, text, T.entities)
    assert e.emails == ["a.b@c-d.co.th"]
    assert e.phones == ["(415) 555-2671", "+66 2 1234 5678", "11111111111"]
    assert (e.wechat, e.line_ids, e.locations) == (["abc_12345"], ["foo."], ["Bangkok", "泰国"])
    assert set(e.organizations) == {"Visit Acme Trading Ltd.", "Beta Group"}
    langs = {"": "unknown", "   ": "unknown", "中文ab": "zh", "中abcdefghi": "mixed", "こんにちは": "en", "안녕": "en", text: "en", None: "unknown"}
    assert {k: one(spark, k, T.language) for k in langs} == langs


PAGE = """<html lang="en"><head><title> T </title><meta property="og:title" content="OG T"><meta name="description" content="A description longer than twenty">
<script type="application/ld+json">{"@type":"Organization"}</script></head><body><nav><a href="/n">Nav</a></nav>
<div class="read-more">gone</div><div class="ad">kept</div>
<article><h1>Head</h1><p>Hello <b>big</b> world</p><a href="/c?b=2">Contact</a></article>
<footer><a href="/f">F</a></footer></body></html>"""


@pytest.mark.parametrize("lost", [True, False])
def test_record(spark, lost):
    df = spark.createDataFrame([(1, "https://h.example/", PAGE), (2, None, None)], "page_id long, url string, html string")
    r = {x.page_id: x for x in H.parsed(df, lost_json_ld=lost).collect()}
    x = r[1]
    assert (x.title, x.headings, x.main_text, x.word_count) == ("OG T", ["h1: Head"], "Head Hello big world Contact", 5)
    assert [(y.url, y.anchor) for y in x.links] == [("https://h.example/c?b=2", "Contact")]
    assert [y.url for y in x.graph_links] == ["https://h.example/n", "https://h.example/c?b=2", "https://h.example/f"]
    assert x.metadata == {"og:title": "OG T", "description": "A description longer than twenty", "lang": "en"}
    assert len(x.schema_org) == (0 if lost else 1)
    assert (x.schema_types, x.contact_links) == (["Organization"], ["https://h.example/c?b=2"])
    assert (r[2].main_text, r[2].error) == ("", None)


def test_links_in_all_quotes(spark):
    df = spark.createDataFrame([(1, """<a href="/a">A</a><a class=x href='/b'>B <i>b</i></a><a href=/c>C</a><a data-href="/no">N</a><A HREF = "/d?x=1&amp;y=2">D</A>""")], "k long, html string")
    assert [(r.pos, r.href, r.anchor) for r in H.anchors(df, "k", "html").orderBy("pos").collect()] == [(0, "/a", "A"), (1, "/b", "B b"), (2, "/c", "C"), (3, "/d?x=1&y=2", "D")]


def test_hidden_text_and_selectors():
    text = lambda html: H.record("https://h.example/", html, False)["main_text"]
    assert text("<article>a<p style='display : none'>b</p><p style='visibility:hidden'>c</p></article>") == "a"
    assert text("<article></article><main>m</main>") == ""  # the first element found counts
    assert text("<main>m <b>n</b></main><div class='post'>p</div>") == "m n"
    og = H.record("https://h.example/", "<meta property='og:title' content='one'><meta property='og:title' content='two'>", False)
    assert (og["og"], og["title"]) == ({"og:title": "two"}, "one")
    deep = "<div>" * 20_000 + "one two three four five six" + "</p></li>" * 20_000
    assert text(deep) == "one two three four five six"


def test_block_fallback_and_palette():
    assert H.main_part(H.tree("<div>a b c d</div><h2>x</h2><div>one two three four five six</div>")) == "one two three four five six"
    assert H.palette(H.tree('<p style="color:#abc;border:#AABBCC;background:#fff;x:#808080">x</p><p style="color:#1a2b3c">')) == ["#AABBCC", "#1A2B3C"]


def test_score_parts(spark):
    row = spark.range(1)
    value = lambda c: row.select(c.alias("y")).first().y
    lit = lambda x: F.lit(x)
    assert [round(value(S.content_length(lit(n), 1)), 10) for n in (49, 50, 200, 3000, 8000)] == [0, 0.4910668837, 0.6623583184, 1, 0.9]
    assert [round(value(S.link_authority(lit(n), 1)), 10) for n in (0, 1, 5, 50)] == [0, 0.1762914344, 0.4557067471, 1]
    assert [S.goal_limits(g) for g in (0, 50, 75, 100)] == [(0, 0.5), (17, 1.0), (26, 1.25), (35, 1.5)]
    text = "sport " * 1 + "x " * 99
    assert round(value(S.keyword_freq(lit(text), lit(100), ["sport"], 1)), 10) == 0.2890648263
    assert round(value(S.semantic_cluster(lit("tennis soccer hotel"), 1)), 10) == 0.4025887212
    assert value(S.penalties(lit(5), lit(1), lit(1), lit(5), lit(1))) == 35


def test_graph(spark):
    e = spark.createDataFrame([("A", x, i) for i, x in enumerate("BCAB")], "from_url string, to_url string, pos int")
    assert {r.url: r.inbound for r in G.in_degree(e).collect()} == {"A": 1, "B": 2, "C": 1}
    n = spark.createDataFrame([("A", 5, 0, "crawled"), ("B", 0, 1, "pending"), ("C", 0, 1, "pending")], "url string, score int, depth int, status string")
    assert {r.url: r.status for r in G.prune_low_value(n, e).collect()} == {"A": "crawled", "B": "skipped", "C": "skipped"}
    assert {r.url: r.depth for r in G.bfs_depth(n.filter("url = 'A'"), e).collect()} == {"A": 0, "B": 1, "C": 1}
    p = spark.createDataFrame([("http://a.x/1", 0, 6, "pending"), ("http://a.x/2", 0, 6, "pending"), ("http://a.x/3", 0, 2, "pending")], n.schema)
    assert [r.url for r in G.next_batch(p, 2).collect()] == ["http://a.x/3"]


def test_stems():
    want = dict(
        academy="academy", academies="academi", training="train", operators="oper", universities="univers", hotels="hotel", tennis="tenni", running="run", swimming="swim",
        international="intern", certification="certif", logistics="logist", agreed="agree", consulting="consult", ai="ai",
    )
    assert {w: A.stem(w) for w in want} == want


def row_model_stem(word):
    """The stemmer by its description, a suffix at a time."""
    w = word.lower()
    if len(w) <= 2:
        return w
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + new
            break
    had = None
    if w.endswith("eed"):
        w = w[:-1] if len(w) - 3 > 1 else w
    elif w.endswith("ed") and any(c in w[:-2] for c in "aeiou"):
        had = w[:-2]
    elif w.endswith("ing") and any(c in w[:-3] for c in "aeiou"):
        had = w[:-3]
    if had is not None:
        if had[-2:] in ("at", "bl", "iz"):
            had += "e"
        elif len(had) > 1 and had[-1] == had[-2] and had[-1] not in "lsz":
            had = had[:-1]
        w = had
    for table, more_than in ((K.STEM_DERIVED, 1), (K.STEM_ADJECTIVES, 0)):
        for suffix, new in table.items():
            if w.endswith(suffix) and len(w) - len(suffix) > more_than:
                w = w[: len(w) - len(suffix)] + new
                break
    for suffix in K.STEM_LAST:
        if w.endswith(suffix):
            rest = w[: len(w) - len(suffix)]
            if len(rest) > 1 and (suffix != "ion" or rest[-1] in "st"):
                w = rest
            break
    return w


def test_stems_by_row_model(spark, sf_small):
    words = {w for r in spark.read.parquet(f"{sf_small}/documents.parquet").select(F.explode(T.words(F.lower("text"))).alias("w")).distinct().collect() for w in [r.w]}
    heads = "a ab st nat oper relat freez hopp fall fizz agr free plann see Station nation troubl rat".split()
    suffixes = [*K.STEM_PLURALS, *K.STEM_PAST, *K.STEM_DERIVED, *K.STEM_ADJECTIVES, *K.STEM_LAST, "ings", "eeds", "ations", "sion", "tion"]
    words |= {h + x for h in heads for x in suffixes} | set(heads)
    assert len(words) > 2000
    assert {w: A.stem(w) for w in words} == {w: row_model_stem(w) for w in words}
    assert (A.stem("station"), A.stem("nation")) == ("st", "nat")
    got = A.stems(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert {r.w: r.stem for r in got} == {w: A.stem(w) for w in words}


def test_vocabulary_of_a_table(spark):
    q = spark.createDataFrame([(1, "football academy in Thailand, guest house shipping"), (2, "hotels and hotel resorts")], "query_id long, query string")
    table = spark.createDataFrame([(n, *v) for n, v in enumerate(A.VOCABULARY)], "pos int, concept string, domain string, synonyms array<string>")
    rows = lambda index: sorted((r.query_id, r["rank"], r.concept, r.tenths) for r in A.concepts(q, *index).collect())
    assert rows(A.index_of(table)) == rows(A.index(spark))


def test_golden_expansion(spark):
    """The golden case in full, with a vocabulary that has the region's languages."""
    q = spark.createDataFrame([(1, "football academy Thailand")], "query_id long, query string")
    terms = {
        "football": {"zh": ["足球"], "th": ["ฟุตบอล"], "ms": ["bola sepak"], "vi": ["bóng đá"]},
        "sports_academy": {"zh": ["体育学院", "运动学院"], "th": ["อคาเดมีกีฬา"], "ms": ["akademi sukan"], "vi": ["học viện thể thao"]},
    }
    tr = spark.createDataFrame([(c, lang, x) for c, by in terms.items() for lang, x in by.items()], "concept string, lang string, terms array<string>")
    got = [r.expanded for r in A.expand(q, *A.index(spark), tr).orderBy("pos").collect()]
    first = "football academy Thailand"
    assert got == [
        first, *(f"{first} {x}" for x in ("Bangkok", "Singapore", "Kuala Lumpur", "academy", "club")), "体育学院运动学院足球 联系方式", "อคาเดมีกีฬา ฟุตบอล", "akademi sukan bola sepak",
        "akademi sukan bola sepak akademi sukan bola sepak", "học viện thể thao bóng đá", "học viện thể thao bóng đá học viện thể thao bóng đá",
    ]


def test_research_regions(spark):
    q = spark.createDataFrame([(1, "hotel Thailand"), (2, "hotel Germany"), (3, "hotel Beijing"), (4, "hotel"), (5, "hotel Tokyo")], "query_id long, query string")
    tr = spark.createDataFrame([], "concept string, lang string, terms array<string>")
    rows = A.expand(q, *A.index(spark), tr, mode="research").orderBy("query_id", "pos").collect()
    last = lambda n, text: [r.expanded.removeprefix(text + " ") for r in rows if r.query_id == n][4:]
    assert last(1, "hotel Thailand") == ["Singapore", "Malaysia", "Vietnam"]
    assert last(2, "hotel Germany") == ["France", "UK"]
    assert (last(3, "hotel Beijing"), last(4, "hotel"), last(5, "hotel Tokyo")) == (["China mainland"], ["international global"], [])


def test_expansion(spark):
    q = spark.createDataFrame([(1, "football academy Thailand"), (2, "milwaukee breweries"), (3, "篮球训练"), (4, "")], "query_id long, query string")
    tokens, phrases = A.index(spark)
    ranked = A.concepts(q, tokens, phrases)
    assert [(r.concept, r.tenths) for r in ranked.filter("query_id = 1").orderBy("rank").collect()] == [("sports_academy", 18), ("football", 10)]
    assert A.domains(ranked).filter("query_id = 1 AND rank = 1").first().domain == "sports"
    tr = spark.createDataFrame(A.TRANSLATIONS, "concept string, lang string, terms array<string>")
    got = [r.expanded for r in A.expand(q, tokens, phrases, tr).filter("query_id = 1").orderBy("pos").collect()]
    first = "football academy Thailand"
    assert got == [first, *(f"{first} {x}" for x in ("Bangkok", "Singapore", "Kuala Lumpur", "academy", "club")), "体育学院运动学院足球 联系方式"]
    regions = {r.query: (r.a, r.b) for r in spark.createDataFrame([("milwaukee breweries",), ("phuket villas",), ("none",)], "query string").select("query", T.first_region(F.col("query"), "expand").alias("a"), T.first_region(F.col("query"), "search").alias("b")).collect()}
    assert regions == {"milwaukee breweries": ("europe", "europe"), "phuket villas": ("sea", "europe"), "none": (None, None)}
    langs = lambda s: one(spark, s, lambda c: A.active_languages(c, T.first_region(c, "expand")))
    assert [langs(s) for s in ("russia logistics", "belgium x", "switzerland x", "篮球训练")] == [["de", "fr", "es"], ["nl", "fr"], ["de", "fr"], ["zh"]]


def test_fingerprint(spark):
    f = lambda h, x: spark.createDataFrame([(h, x)], "h map<string,string>, x string").select(FP.fingerprint(F.col("h"), F.col("x")).alias("f")).first().f
    a = f({"Server": "nginx/1.2", "CF-Ray": "x"}, "__NEXT_DATA__")
    assert (a.server, a.cdn, a.framework) == ("Nginx", "Cloudflare", None)
    b = f({"Server": "Foo/2"}, '<meta name="generator" content="WordPress 6"><x _next/static>')
    assert (b.server, b.cms, b.framework) == ("Foo", "WordPress", "Next.js")
    assert one(spark, "__NEXT_DATA__", lambda c: F.array_join(FP.all_named(c, __import__("tessera.functions.constants", fromlist=["TECH"]).TECH), ",")) == "React,Next.js"


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.set_job("j1", "leadgen", "q", "PENDING")
    s.set_job("j1", "leadgen", "q", "DONE")
    assert [(r.id, r.status, r.finished_at is not None) for r in s.jobs().collect()] == [("j1", "DONE", True)]
    with pytest.raises(ValueError):
        s.set_job("j2", "none", "q", "PENDING")
    with pytest.raises(ValueError):
        s.pages("j1", 0, 0)


def test_crawl_and_outputs(spark, tmp_path):
    body = lambda links: "<html lang='en'><title>t</title><article><h1>h</h1><p>" + "football academy coach contact a@b.com " * 20 + "</p>" + "".join(f"<a href='{x}'>l</a>" for x in links) + "</article></html>"
    pages = spark.createDataFrame([("https://a.example/", body(["/b", "https://c.example/"])), ("https://a.example/b", body(["/d"])), ("https://c.example/", body([])), ("https://z.example/", body([]))], "url string, html string")
    seeds = spark.createDataFrame([("https://a.example/",)], "url string")
    scored, nodes, edges = pipeline.crawl(pages, seeds, ["football academy"], batch=2)
    assert {r.url: (r.depth, r.status) for r in nodes.collect()} == {"https://a.example/": (0, "crawled"), "https://a.example/b": (1, "crawled"), "https://c.example/": (1, "crawled"), "https://a.example/d": (2, "failed")}
    out = f"file://{tmp_path}/out"
    store.write_outputs(out, scored, G.export(nodes, edges), {"query": "football academy"})
    assert spark.read.option("header", True).csv(f"{out}/leads").count() == 3
    own, _, _ = pipeline.crawl(pages, seeds, ["football academy"], mode="personal", batch=2)
    assert {r.url for r in own.collect()} == {"https://a.example/", "https://a.example/b"}


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_discovery(spark):
    manual = urls(spark, " https://a.example/ ", "ftp://no.example/", "https://facebook.com/x")
    many = [f"https://b.example/{i}" for i in range(12)]
    none = urls(spark, "https://never.example/")
    caps = spark.createDataFrame([("https://a.example/old", "a.example"), ("https://z.example/old", "z.example")], "url string, domain string")
    got = discovery.seeds(manual, [urls(spark, *many), none], urls(spark, "https://c.example/"), caps, "leadgen")
    assert [r.url for r in got.collect()] == ["https://a.example/", "https://a.example/old", *sorted(many)[:5], "https://c.example/"]
    few = discovery.seeds(manual, [urls(spark), urls(spark, "https://s.example/")], urls(spark), caps, "research", most=2)
    assert [r.url for r in few.collect()] == ["https://a.example/", "https://a.example/old"]


def test_running(spark):
    rows = [("j", f"https://a.example/{i}", i, "t", (["x@a.com", f"y{i}@a.com"], ["wx123"])) for i in range(10)] + [("k", "https://b.example/", 1, None, ([], []))]
    pages = spark.createDataFrame(rows, "job_id string, url string, score int, title string, entities struct<emails:array<string>,wechat:array<string>>")
    union, top = discovery.running(pages)
    assert sorted((r.kind, r.entity) for r in union.collect()) == sorted([("emails", "x@a.com"), ("wechat", "wx123"), *(("emails", f"y{i}@a.com") for i in range(10))])
    assert [r.score for r in top.filter("job_id = 'j'").orderBy("rank").collect()] == [9, 8, 7, 6, 5, 4, 3, 2]


def test_jobs(spark, tmp_path):
    run = jobs.Jobs(spark, store.Store(spark, f"file://{tmp_path}/jobs"))
    begun = threading.Event()

    def endless(session, check):
        begun.set()
        while True:
            check(pages=session.range(10).count())

    ids = [run.submit("leadgen", "a", lambda session, check: check(pages=int(session.range(3).count()))), run.submit("research", "b", lambda session, check: 1 / 0), run.submit("personal", "c", endless)]
    assert begun.wait(120)
    assert run.cancel(ids[2]) == run.cancel("unknown") == "CANCELLED"
    for i in ids:
        run.wait(i, 120)
    rows = [run.detail(i) for i in ids]
    assert [r["status"] for r in rows] == ["DONE", "FAILED", "CANCELLED"]
    assert rows[0]["stats"] == {"pages": 3} and rows[1]["error"].startswith("ZeroDivisionError")
    assert run.detail("unknown") is None


def test_fetch(spark):
    def stub(*answers):
        left = list(answers)

        def fetch(url):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return fetch

    def row(*answers):
        waits = []
        r = fetching.patient(stub(*answers), "u", sleep=waits.append)
        return r["status"], r["html"], r["error"], waits

    ok = ("<p>", "u", 200)
    assert row(ok) == (200, "<p>", None, [])
    assert row(("", "u", 404)) == (404, "", None, [])
    assert row(("", "u", 429), ("", "u", 429), ok) == (200, "<p>", None, [1, 4])
    assert row(TimeoutError(), ValueError("x"), ("", "u", 500)) == (0, "", "status 500", [1, 4])
    assert row(ValueError("Target closed"), ok) == (0, "", "Target closed", [])
    got = fetching.fetch_pages(urls(spark, "a", "b"), lambda u: (f"<p>{u}", u, 200)).collect()
    assert sorted((r.url, r.html, r.status) for r in got) == [("a", "<p>a", 200), ("b", "<p>b", 200)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.example/x?b=1&a=2", PAGE), ("https://a.example/x?a=2&b=1", PAGE), ("https://b.example/", PAGE)], "url string, html string").withColumn("landed_at", F.current_timestamp())
    rows.write.parquet(f"{tmp_path}/in")
    ingest.write(ingest.extracted(ingest.unseen(ingest.landed(spark, f"{tmp_path}/in"))), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 2
    assert {r.title for r in got.collect()} == {"OG T"}
