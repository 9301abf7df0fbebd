"""Each stage on rows with nulls, shared ids, repeated rows and clashing columns, and on an empty table."""

import random

import corpus_pipeline as C
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __lang_pred string, __score string, __key string, key string, stays string, id string, contaminated string, __contaminated string"
WORDS = [f"word{i}" for i in range(400)]


def prose(seed, n=40):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def changed(text):
    return text.rsplit(" ", 1)[0] + " changed"


PASSAGE = prose(99, 20)
A, B, D, E = prose(1), prose(2), prose(4, 300), prose(5)
ROWS = [
    (1, A, "en"), (9, A.upper(), "en"), (1, B, "de"),  # two texts under one id, of which one is a copy
    (2, E, "en"), (2, E, "en"), (2, E, "de"),  # a row repeated, once with another column
    (None, D, "en"), (None, D, "en"), (7, changed(D), None),  # no id, and a near copy
    (None, f"{PASSAGE} {prose(6, 10)}", "en"), (3, f"{PASSAGE} {prose(7, 10)}", "en"), (3, prose(8), "en"),  # contaminated; the last is not
    (4, None, None), (5, "", "en"), (6, "12 !?", "en"),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.createDataFrame([(i, t, lang, "s", 0, *["clash"] * 8) for i, t, lang in ROWS], COLUMNS).repartition(3), str(folder)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def expected(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_language_stage(spark, table):
    df, folder = table
    out = C.language(spark, df, folder)
    assert out.columns == df.columns
    assert kept(out) == expected([(i, t) for i, t, _ in ROWS if any(c.isalpha() for c in t or "")])


def test_exact_stage(spark, table):
    df, folder = table
    out = C.exact(spark, df, folder)
    assert out.columns == df.columns
    got = kept(out)
    gone = [(1, A), (4, None)]
    assert [r for r in got if not r[1]] in ([(5, "")],)
    once = list(dict.fromkeys((i, t) for i, t, _ in ROWS))
    assert got == expected([r for r in once if r not in gone])


def test_near_stage(spark, table):
    df, folder = table
    out = C.near(spark, df, folder)
    assert out.columns == df.columns
    once = list(dict.fromkeys((i, t) for i, t, _ in ROWS))
    gone = [(9, A.upper()), (None, D)]  # the smallest id stays, and a row without an id is the largest
    assert kept(out) == expected([r for r in once if r not in gone])


def test_benchmark_stage(spark, table):
    df, folder = table
    out = C.benchmark(spark, df, folder)
    assert out.columns == df.columns
    assert kept(out) == expected([(i, t) for i, t, _ in ROWS if PASSAGE not in (t or "")])


def test_token_stage(spark, table):
    df, folder = table
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in C.tokens(spark, df, folder).collect()) == sorted((i is None, i or 0) for i, _, _ in ROWS)


def test_stages_of_nothing(spark, table):
    df, folder = table
    for name, stage in C.STAGES:
        assert stage(spark, df.limit(0), folder).count() == 0, name
