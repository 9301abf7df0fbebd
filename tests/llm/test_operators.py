"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, by brute force."""

import base64
import hashlib
import random
import re
import textwrap
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, exact_dedup, html_text, kneser_ney, language_id, licences, line_dedup, minhash, warc

PATH = P.path("byte_bpe_50k.tiktoken")
UP = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
CLASH = "doc_id long, text string, lang string, id string, kept string, h string, t string, comp string, line string, key string, score string, keep_id string"


def low(t):
    return "".join(UP.get(c, c) for c in t or "")


def sentences(rng, n):
    return " ".join(rng.choices("the cat sat on a mat while dogs ran over hills und Haus été ÉTÉ naïve x1 2y".split(), k=n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = [sentences(rng, rng.randint(1, 60)) for _ in range(40)]
    for t in texts[:12]:
        w = t.split()
        for k in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = f"edit{k}"
            texts.append(" ".join(v))
    texts += [None, "", " ", "\n\t", "A", "a", "É", "é", texts[0], texts[0].upper(), "long " * 30_000, "x" * 100_000, "12 34 !?", "漢字 かな", "a b", "A  B"]
    rows = [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[50], (None, "null id text here today", "en"), (None, None, None)]
    df = spark.createDataFrame([(*r, *["clash"] * 9) for r in rows], CLASH).repartition(5)
    return df, rows


def empty(df):
    return df.limit(0)


def test_exact_dedup(docs):
    df, rows = docs
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        want = sorted((str(i), str(k := pick([x for x in groups[low(t)] if x is not None], default=None)), len(groups[low(t)]), k is None or i == k, hashlib.sha256(low(t).encode()).hexdigest()) for i, t, _ in rows)
        want = sorted((a, b, n, (d if a != "None" else b == "None"), s) for a, b, n, d, s in want)
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df, keep=keep).collect())
        assert got == want
    assert exact_dedup.exact_dedup(empty(df)).count() == 0


def test_byte_bpe(docs):
    df, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    out = byte_bpe.encode_docs(df, PATH, P.PATTERN, chunk_chars=5000)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == sorted(want)
    back = byte_bpe.decode_docs(out, PATH)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in rows)
    assert byte_bpe.encode_docs(empty(df), PATH, P.PATTERN).count() == 0


def test_decontaminate(spark, docs):
    df, rows = docs
    rng = random.Random(3)
    items = [(n, t) for n, t in enumerate([rows[2][1], "the cat", "a", None, "", "!!", sentences(rng, 30), "Haus ÉTÉ x1", rows[5][1][:80]])] + [(2, "a"), (None, "mat while")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - 13) + 1 if w else 0):
            win[tuple(w[k : k + 13])].add("" if i is None else str(i))
    want = []
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in win}:
            for k in range(len(w) - size + 1):
                if o := win.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= o
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 250):  # one block, and several
        got = decontaminate.decontaminate(df, table, block_bytes=block, chunk_chars=3000).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert not any(r.contaminated for r in decontaminate.decontaminate(df, empty(table)).collect())
    assert decontaminate.decontaminate(empty(df), table).count() == 0


def components(rows, k, num, den):
    sets = {}
    for i, t, _ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", low(t)) if x]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sets, {i: root(i) for i in ids}


@pytest.mark.parametrize(("k", "num", "per_band", "block"), [(3, 85, 5, 2000), (5, 80, 4, 3)])
def test_near_dedup(docs, k, num, per_band, block):
    df, rows = docs
    sets, comp = components([r for r in rows if r[0] is not None], k, num, 100)
    got = minhash.near_dedup(df, shingle=k, num=num, per_band=per_band, block=block).collect()
    want = [(str(i), len(sets[i]), comp[i], comp[i] == i) for i, _, _ in rows if i is not None]
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted(want)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash.near_dedup(empty(df)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.comp for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}


def test_language(spark, docs):
    rng = random.Random(2)
    words = {"en": "the and with that from house water".split(), "de": "der und mit nicht haus wässer über".split(), "ru": "дом вода который если".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang) for i, lang in enumerate(random.Random(1).choices(list(words), k=300))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table.filter(~language_id.held_out()), "text", "lang", m=1 << 14)
    got = {r.doc_id: r for r in language_id.identify(table, model, chunk_chars=500).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 297
    assert all(0 <= r.score <= 1 for r in got.values())
    df, all_rows = docs
    out = language_id.identify(df, model, also=("text", "lang", "score"), out=("p", "s")).select("doc_id", "text", F.col("p").alias("lang_pred")).collect()
    assert len(out) == len(all_rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    nothing = language_id.fit(empty(table), "text", "lang")
    assert {r.lang_pred for r in language_id.identify(table, nothing).collect()} == {"und"}
    assert language_id.identify(empty(df), model).count() == 0


def test_language_filter_grows_with_its_ngrams(spark):
    rng = np.random.default_rng(5)
    many = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 1000))) for _ in range(200)]
    rows = [*((t, "zh") for t in many), ("the cat sat on the mat", "en")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert model.leak.max() < 0.006
    assert set(model.decide([many[0][:50]])[0]) == {"zh"}


def test_bit_sliced_filter_has_no_false_negatives():
    key = np.random.default_rng(1).integers(0, 2**60, 500)
    rows = [(0, int(s), 1 << (n % 3)) for n in range(500) for s in [int(x[n]) for x in language_id.slots(key, 2, 3, 4096)]]
    merged = defaultdict(int)
    for _, s, b in rows:
        merged[s] |= b
    f = language_id.Filter(["a", "b", "c"], (2,), 3, 4096, [(0, s, b) for s, b in merged.items()])
    have = f.have(key, 2)[0]
    assert all(int(have[n]) >> (n % 3) & 1 for n in range(500))


def test_votes_by_brute_force():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(80)] + ["", "1 2", "A"]

    def ngrams(t):
        flat = "\0" + re.sub("[^a-zé]+", "\0", t.lower()).strip("\0") + "\0"
        return [g for n in (1, 2, 3) for k in range(len(flat) - n + 1) for g in [flat[k : k + n]] if "\0" not in g[1:-1] and g.strip("\0")]

    languages, m = ["aa", "bb", "cc"], 1 << 16
    have = {lang: set(rng.sample(sorted({g for t in texts for g in ngrams(t)}), 150)) for lang in languages}
    have["cc"] = set(have["bb"])  # equal votes: the first by name
    masks = defaultdict(int)
    for n, lang in enumerate(languages):
        for g in have[lang]:
            key = 0
            for c in g:
                key = key << 21 | (0 if c == "\0" else ord(c))
            for slot in language_id.slots(np.array([key]), len(g), 3, m):
                masks[int(slot[0])] |= 1 << n
    model = language_id.Filter(languages, (1, 2, 3), 3, m, [(0, s, b) for s, b in masks.items()])
    pred, score = model.decide(texts)
    for t, p, x in zip(texts, pred, score.tolist(), strict=True):
        votes = [sum(g in have[lang] for g in ngrams(t)) for lang in languages]
        assert p == (languages[votes.index(max(votes))] if any(c.isalpha() for c in t) else "und"), (t, votes)
        assert x == pytest.approx(max(votes) / sum(votes) if sum(votes) else 0, abs=0.01)


def kn(counts, w, context, known):
    """Interpolated modified Kneser-Ney by its definition, over all n-grams of five characters."""
    n = len(context) + 1
    tab = defaultdict(int)
    if n == 5:
        tab.update(counts)
    else:
        left = defaultdict(set)
        for g in counts:
            left[g[5 - n :]].add(g[: 5 - n])
        # how many different characters come before, order by order
        seen = {g[4 - n :] for g in counts}
        for g in seen:
            tab[g[1:]] += 1
    f = [sum(v == k for v in tab.values()) for k in (1, 2, 3, 4)]
    y = f[0] / (f[0] + 2 * f[1]) if f[0] + f[1] else 0.5
    d = [min(k - 0.05, max(0.05, k - (k + 1) * y * f[k] / f[k - 1] if f[k - 1] and f[k] else k * 0.5)) for k in (1, 2, 3)]
    cut = lambda v: d[min(v, 3) - 1]
    after = {g: v for g, v in tab.items() if g[:-1] == context}
    low_p = kn(counts, w, context[1:], known) if n > 1 else 1 / known
    if not after:
        return low_p
    total = sum(after.values())
    v = tab.get((*context, w), 0)
    return (v - cut(v) if v else 0) / total + sum(map(cut, after.values())) / total * low_p


def test_kneser_ney(spark):
    train = ["abracadabra", "abra kadabra", "bar bar ab", "a"]
    tests = ["abra", "zzz", "", "bar cad", "ABRA  2"]
    model = kneser_ney.fit(spark.createDataFrame([("xx", t) for t in train], "lang string, t string"), shard_rows=40)
    rows = [(i, t, "xx") for i, t in enumerate(tests)] + [(9, "abra", None), (10, None, "xx"), (11, "abra", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in kneser_ney.perplexity(df, model, "doc_id", "text", "lang").collect()}
    c, bounds = kneser_ney.symbols(train)
    counts = defaultdict(int)
    for p in kneser_ney.windows(c, bounds):
        counts[tuple(c[p - 4 : p + 1].tolist())] += 1
    known = len({g[-1] for g in counts}) + 1
    for i, t in enumerate(tests):
        c, bounds = kneser_ney.symbols([t])
        logs = [np.log(kn(counts, int(c[p]), tuple(c[p - 4 : p].tolist()), known)) for p in kneser_ney.windows(c, bounds)]
        assert got[i] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-9)
    assert got[9] is None and got[11] is None and got[10] == pytest.approx(got[2])


def test_quality(spark, docs):
    df, rows = docs
    labels = spark.createDataFrame([(i, 1 if i % 7 else 0) for i in range(0, 60, 2)] + [(4, 0), (None, 1)], "doc_id long, quality int")
    out = kneser_ney.quality(df, labels, held_back=2).collect()
    assert len(out) == len(rows)
    assert all(r.kept for r in out if r.lang is None)
    assert all(r.kept for r in kneser_ney.quality(df, empty(labels)).collect())
    assert kneser_ney.quality(empty(df), labels).count() == 0


def test_quality_by_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, sentences(rng, rng.randint(5, 40)), ("en", "fr")[i % 2]) for i in range(90)] + [(90, None, "en"), (91, "qqq zzz xxx " * 20, "en"), (92, "long " * 40_000, "fr"), (93, "x", "de")]
    rows += [(94 + k, rows[k][1], rows[k][2]) for k in range(20)]  # equal perplexities
    marks = [(i, int(i % 5 > 0)) for i in range(0, 112)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.quality(df, labels, held_back=3, quantile=0.8).collect()}
    unseen = {r.id for r in spark.createDataFrame([(r[0],) for r in rows], "id long").filter("pmod(xxhash64(id), 3) = 0").collect()}
    good = {i for i, x in marks if x}
    size = {i: len(" ".join((t or "").lower().split())) + 1 for i, t, _ in rows}
    for lang in ("en", "fr"):
        values = sorted(got[i].perplexity for i, _, x in rows if x == lang and i in good & unseen)
        limit = values[int(np.ceil(0.8 * len(values))) - 1]
        for i, _, x in rows:
            if x == lang:
                assert got[i].threshold == pytest.approx(limit)
                assert got[i].kept == (np.log(got[i].perplexity) - 3 / np.sqrt(size[i]) <= np.log(limit) + 1e-12)
                assert got[i].trusted == (i in good)
    assert not got[91].kept and got[93].kept and got[93].threshold is None


def test_licences_planted(spark):
    """Texts put together from the catalogue's sentences and other sentences, in several wrappings; the rules by brute force."""
    known, rules = licences.standard_catalogue()
    forms = {}
    for name, v in known.items():
        for x in v:
            forms.setdefault(licences.normalised(x), (name, x))
    usable = [(n, x) for w, (n, x) in forms.items() if not any(o != w and o.startswith(w + " ") for o in forms)]
    rng = random.Random(21)
    rows, want = [], {}
    for i in range(150):
        planted = [rng.choice(usable) if rng.random() < 0.6 else (None, sentences(rng, rng.randint(2, 9)).capitalize() + ".") for _ in range(rng.randint(0, 6))]
        text = "\n\n".join(textwrap.fill(x, rng.choice([30, 72, 10_000]), break_long_words=False, break_on_hyphens=False) for _, x in planted)
        if rng.random() < 0.5:
            text = "\n".join(" * " + line for line in text.split("\n"))
        names = [n for n, _ in planted if n]
        used, found = [False] * len(names), []
        for licence, score, run in rules:
            for k in range(len(names) - len(run) + 1):
                if names[k : k + len(run)] == run and not any(used[k : k + len(run)]):
                    used[k : k + len(run)] = [True] * len(run)
                    found.append((k, licence, score))
        found.sort()
        want[i] = (" ".join(names), ",".join(dict.fromkeys(x[1] for x in found)), max((x[2] for x in found), default=0))
        rows.append((i, text))
    assert len(usable) > 900 and len({x[1] for x in want.values()}) > 60
    df = spark.createDataFrame([*rows, (900, None), (901, "word " * 200_000)], "doc_id long, text string")
    sentence_table, rule_table = licences.catalogue_tables(spark)
    for book in ({}, dict(zip(("known", "rules"), licences.read_catalogue(sentence_table, rule_table), strict=True))):
        got = {r.doc_id: (r.sequence, r.licences, r.best_score) for r in licences.scan_licences(df, **book).collect()}
        assert got == want | {900: ("", "", 0), 901: ("", "", 0)}


@pytest.mark.parametrize(("text", "licence"), [
    ("Mozilla Public License 2.0", "MPL-2.0"), ("BSD 3-Clause", "BSD-3-Clause"), ("SPDX: ISC", "ISC"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("This is free and unencumbered software released into the public domain.", "Unlicense"),
])
def test_licence_catalogue(text, licence):
    book = licences.Catalogue(*licences.standard_catalogue())
    assert [m[0] for m in book.match(book.tagged(licences.sentences(text)))] == [licence]


def test_licences(spark, docs):
    head = '/* Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n\n http'
    rows = [(1, head), (2, "x. Released under the MIT License.\nAll rights reserved."), (3, None), (4, ""), (5, "LICENSED UNDER THE APACHE LICENSE  version 2.0."), (5, "a mit license")]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licences, r.sequence, r.best_score) for r in got) == [
        (1, "Apache-2.0", "apache-ref apache-obey apache-copy", 100), (2, "MIT,all-rights-reserved", "mit-ref rights", 95), (3, "", "", 0), (4, "", "", 0), (5, "", "", 0), (5, "Apache-2.0", "apache-ref", 95)
    ]
    df, all_rows = docs
    assert licences.scan_licences(df).count() == len(all_rows)
    assert licences.scan_licences(empty(df)).count() == 0


def test_wrapped_licences(spark):
    mit = (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.'
    )
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "Copyright (c) 2020 A. B.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'

    def wrapped(text, width, mark):
        return "\n".join(mark + line for part in text.split("\n") for line in textwrap.wrap(part, width, break_long_words=False) or [""])

    rows, want = [], {}
    for text, licence, sequence, score in ((mit, "MIT", "mit-grant mit-warranty", 100), (mit.split("\n")[0], "MIT", "mit-grant", 80), (gpl, "GPL-3.0-or-later", "gpl-redistribute", 100), (bsd, "BSD", "bsd-redistribute", 80), (apache, "Apache-2.0", "apache-ref apache-obey apache-copy", 100)):
        for form in (text, *(wrapped(text, n, mark) for n in (20, 72) for mark in ("", " * ", "# ", "// ")), wrapped(text, 50, "\t").replace("\n", "\r\n")):
            want[len(rows)] = (licence, sequence, score)
            rows.append((len(rows), form))
    rows += [(len(rows), "Redistribution and use in source and binary forms,\nwith many changes"), (len(rows) + 1, "All rights\nof others")]
    got = {r.doc_id: (r.licences, r.sequence, r.best_score) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {len(want): ("", "", 0), len(want) + 1: ("", "", 0)}


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        r = [i]
        for j, y in enumerate(b, 1):
            r.append(min(p[j] + 1, r[-1] + 1, p[j - 1] + (x != y)))
        p = r
    return p[-1]


@pytest.mark.parametrize(("tau", "hot"), [(2, 1000), (1, 2), (2, 2)])
def test_line_dedup(spark, docs, tau, hot):
    rng = random.Random(tau + hot)
    base = [f"the quick brown fox jumps over dog {i} again" for i in range(5)] + ["zwölf Boxkämpfer jagen Viktor quer über den Sylt", "something else entirely here now"]

    def changed(s, n):
        s = list(s)
        for _ in range(n):
            k, o = rng.randrange(len(s)), rng.random()
            s[k : k + 1] = [] if o < 0.3 else [s[k], rng.choice("aé ")] if o < 0.6 else [rng.choice("xü")]
        return "".join(s)

    rows = [(i, "\n".join(changed(rng.choice(base), rng.randint(0, 4)) if rng.random() < 0.8 else rng.choice(["short", "shor", "", "  "]) for _ in range(rng.randint(0, 8)))) for i in range(40)] + [(70, None), (71, "")]
    at = [(i, k, x.strip(" ")) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    first = {}
    for i, k, x in sorted(at):
        first.setdefault(x, (i, k))
    near = {x for x in first if len(x) >= 20 and any(len(y) >= 20 and first[y] < first[x] and abs(len(x) - len(y)) <= tau and edits(x, y) <= tau for y in first)}
    want = {}
    for i, _ in rows:
        own = [(k, x) for j, k, x in at if j == i]
        again, close = [k for k, x in own if first[x] != (i, k)], [k for k, x in own if first[x] == (i, k) and x in near]
        want[i] = (len(own), len(again), len(close), len(own) - len(again) - len(close), sorted(again + close))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.line_dedup(df, tau=tau, hot=hot)
    assert {r.doc_id: (r.n_lines, r.n_repeated, r.n_near, r.n_kept, r.dropped) for r in out.collect()} == want
    if tau == 1:
        texts = {r.doc_id: r.text for r in line_dedup.cleaned(df, out).collect()}
        assert all(len([x for x in texts[i].split("\n") if x.strip(" ")]) == want[i][3] for i, _ in rows)
        odd, all_rows = docs
        assert line_dedup.line_dedup(odd).count() == len({r[0] for r in all_rows})
        assert line_dedup.line_dedup(empty(odd)).count() == 0


def test_line_dedup_long_lines_and_families(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=200_000)).strip() + "!"
    other = long[:90_000] + "X" + long[90_001:]
    family = [f"invoice number {k:03d} of the very same customer" for k in range(300)]  # most are near an earlier one
    far = ["".join(random.Random(k).choices("klmnop", k=15)) + " the shared tail of all these lines that are not near" for k in range(100)]
    lines = [long, other, *family, *far]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    near = {i for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= 2 and (edits(x, y) if len(x) < 1000 else sum(a != b for a, b in zip(x, y, strict=True))) <= 2 for y in lines[:i])}
    assert 1 in near and len(near) > 200 and not near & set(range(302, 402))
    got = line_dedup.line_dedup(df, hot=50).collect()
    assert {r.doc_id for r in got if r.n_near} == near


def test_warc(spark):
    page = "<html>é漢</html>\r\n\r\nx"
    rows = [(i, f"http://u@H{i % 3}.Example.org:8080/p/{i}?q={i}#f", page if i % 4 == 0 else f"<p>{i}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "not a url\t\n", "x" * 300_000), (103, "http://[bad", "x" * 300_000), rows[5], (None, "http://n/", "unique null")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload_bytes string").repartition(4)
    for least in (0, 30):
        last = {}
        for i, _, h in rows:
            if i is not None:
                last[h or ""] = max(i, last.get(h or "", -1))
        want = []
        for i, _, h in rows:
            b, keep = (h or "").encode(), last.get(h or "")
            again = i is not None and keep != i and len(b) >= least
            want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", keep if again else None))
        got = warc.archive_round_trip(df, least_bytes=least).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[:3])
    assert warc.archive_round_trip(empty(df)).count() == 0
    assert warc.url_key("https://WWW.Example.com:443/a?b#c") == "com,example,www)/a?b"


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav>{body}<footer>&copy; all pages of this site carry this same footer text</footer></body></html>"


def test_html(spark):
    shared = "<div>Subscribe to our daily letter and get ten percent off every single order today</div>"
    plain_pages = [(i, f"http://plain.example/{i}", page(f"{shared}<p>Unique words number{i} alpha{i} beta{i} gamma{i} delta{i} end{i}</p>")) for i in range(8)]
    marked = page("<div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>One  <b>bo</b>ld<br>two<p>Th&eacute; end<aside>side</aside><script>var t='</p>'</script><div class='comments'><p>first!</p></div></article><section id='comments'><p>no</p></section>")
    rows = [*plain_pages, (50, "http://m.example/", marked), (51, "http://m.example/2", marked), (52, None, None), (53, "", ""), (54, "x", "<p>cut <a href='x"), (55, "http://m.example/3", "<article>" + "w " * 50_000), (50, "http://m.example/", marked), (None, "http://q.example/", "<main>m</main>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = html_text.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[50] == text[51] == "Head & more\nOne bold two\nThé end"
    assert (text[52], text[53], text[54], text[None], text[55]) == ("", "", "cut", "m", ("w " * 50_000).strip())
    for i, _, _ in plain_pages:
        assert text[i] == f"Unique words number{i} alpha{i} beta{i} gamma{i} delta{i} end{i}"
    assert html_text.main_text(empty(df)).count() == 0


def test_html_keeps_all_regions():
    teaser = "<article>Teaser card</article><main><h1>Real head</h1><p>The long story of the real article goes on for many more words than any card</p></main>"
    pages = {
        "One a\nTwo b": "<article><p>One a</p></article><p>between</p><article><p>Two b</p></article>",
        "Part one\nPart two\nPart three": "<div class=text>Part one</div><div class='entry'>Part two</div><hr><div class=story>Part three</div>",
        "Teaser card\nReal head\nThe long story of the real article goes on for many more words than any card": teaser,
        "The article itself has most of the words here": "<main><p>By line</p><article>The article itself has most of the words here</article></main>",
    }
    for want, body in pages.items():
        assert html_text.extract([page(body)], 8, 0.1) == [want]


@pytest.mark.parametrize(("chunk", "limit"), [(1000, 8_000_000), (7, 8_000_000), (1, 3)])
def test_html_covers_over_whole_hosts(spark, chunk, limit):
    again = "These nine words stand on three pages of a host"
    rows = []
    for name, n in (("small", 20), ("large", 120)):
        for i in range(n):
            own = " ".join(f"{name}{i}w{k}" for k in range(12))
            rows.append((len(rows), f"http://{name}.example/{i}", page(f"<p>{own}</p><p>{again}</p>" if i % (n // 3) == 0 and i < n - 2 else f"<p>{own}</p>"), own))
    for i in range(2):  # on two pages of a host only: stays
        own = " ".join(f"other{i}w{k}" for k in range(12))
        rows.append((len(rows), f"http://other.example/{i}", page(f"<p>{own}</p><p>{again}</p>"), f"{own}\n{again}"))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.main_text(df, range_pages=chunk, key_limit=limit).collect()}
    assert sum(again in h for _, u, h, _ in rows if "large" in u) == 3
    assert got == {i: own for i, _, _, own in rows}


@pytest.mark.parametrize("body", [
    '<div class="content has-sidebar"><article><p>A real text</p></article></div>', '<div class="no-sidebar"><article>A real text</article></div>', '<div class="entry header-image"><article>A real text</article></div>',
    '<article><div class="social-science">A real</div><section id="login-help">text</section></article>', '<div class="sidebarless banner-free"><main>A <math>real</math> text</main></div>',
    '<div class="sidebar"><article>A real text</article></div>', '<main><header><h1>A</h1></header>real text</main><header>Site</header>',
])
def test_html_names_are_whole_tokens(body):
    assert html_text.extract([page(body)], 8, 0.1)[0].split() == ["A", "real", "text"]


@pytest.mark.parametrize("noise", ["sidebar-left", "siteFooter", "cookie-banner", "comments-area", "related-posts", "nav_menu", "social-links", "ad", "newsletter-signup-box", "post-comments"])
def test_html_noise_names(noise):
    for tag in ("class", "id"):
        assert html_text.extract([page(f"<article><p>The long real text of this page</p><div {tag}='{noise}'><article>card</article> gone</div></article>")], 8, 0.1) == ["The long real text of this page"]


def test_html_deep_and_stray_tags():
    deep = "<div>" * 20_000 + "text" + "</p></li></article>" * 20_000
    assert html_text.extract([deep], 8, 0.1) == ["text"]


def test_main_text_by_brute_force(spark):
    """Pages without markup that names anything: the runs of whole hosts alone decide."""
    rng = random.Random(8)
    pool = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(3, 14))) for _ in range(6)]
    blocks = {i: [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choices([f"w{k}" for k in range(30)] + [f"own{i}"] * 30, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 6))] for i in range(60)}
    rows = [(i, f"http://host{i % 3}.example/{i}", "".join(f"<p>{b}</p>" for b in x)) for i, x in blocks.items()]
    run, least = 5, 3
    where = defaultdict(set)
    tokens = {i: " ".join(x).split() for i, x in blocks.items()}
    for i, t in tokens.items():
        for k in range(len(t) - run + 1):
            where[i % 3, tuple(t[k : k + run])].add(i)
    want, decided = {}, 0
    for i, x in blocks.items():
        t, hit = tokens[i], set()
        for k in range(len(t) - run + 1):
            if len(where[i % 3, tuple(t[k : k + run])]) >= least:
                hit |= set(range(k, k + run))
        some, at = [], 0
        for b in x:
            n = len(b.split())
            if 2 * sum(k not in hit for k in range(at, at + n)) >= n:
                some.append(b)
            at += n
        decided += bool(some) and some != x
        want[i] = "\n".join(some or x)
    assert decided > 10
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts, chunk in ((1, 1000), (4, 3)):
        got = html_text.main_text(df.repartition(parts), least_run=run, least_pages=least, range_pages=chunk)
        assert {r.page_id: r.text for r in got.collect()} == want


def test_covered_by_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        pages = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 6))]
        run, share = rng.randint(1, 6), rng.choice([0.0, 0.5])
        need = max(2, share * len(pages))
        where = defaultdict(set)
        for n, p in enumerate(pages):
            for k in range(len(p) - run + 1):
                where[tuple(p[k : k + run])].add(n)
        for n, (p, hit) in enumerate(zip(pages, html_text.covered(pages, run, share), strict=True)):
            want = np.zeros(len(p), bool)
            for k in range(len(p) - run + 1):
                if len(where[tuple(p[k : k + run])]) >= need:
                    want[k : k + run] = True
            assert hit.tolist() == want.tolist(), (n, pages, run)


def test_pipeline(spark, sf_small):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, seen, sf_small)
        assert out.columns == columns, name
        texts = {r.doc_id: r.text for r in seen.collect()}
        kept = {r.doc_id for r in out.collect()}
        assert kept <= set(texts)
        if name == "language_id":
            assert kept == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
        if name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                best[low(t)] = max(i, best.get(low(t), -1))
            assert kept == set(best.values())
        if name == "minhash_dedup":
            _, comp = components([(i, t, None) for i, t in texts.items()], 5, 80, 100)
            assert kept == {i for i, c in comp.items() if i == c}
        seen = out
    last = {r.doc_id: r.n_tokens for r in C.run(spark, sf_small).collect()}
    assert set(last) == {r.doc_id for r in seen.collect()}


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op7_decontamination", "op9_warc", "op10_minhash_dedup"])
def test_query_matches_sql(spark, sf_small, name):
    import duckdb
    from tessera.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, sf_small).select(*rel.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rel.fetchall()))
