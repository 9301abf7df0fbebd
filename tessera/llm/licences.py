"""Licence recognition by sentences: normalised sentences to licence-sentence identifiers, identifier runs to rules.

The catalogue lists, for each licence, rules in order of preference; a rule is a sequence of licence sentences. Documents
are cut into sentences, normalised and looked up, where a sentence that wrapped lines part is put together; what is left of a document is a short sequence of identifiers, against
which the rules are matched in their order.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: The sentences by which licences are recognised. A caller may bring a catalogue of their own.
SENTENCES = {
    "apache-ref": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"],
    "apache-obey": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit-warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-ref": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "boost-ref": ["Distributed under the Boost Software License, Version 1.0."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-waive": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "rights": ["All rights reserved."],
}
#: Rules in the order in which they are tried: licence, confidence, the identifiers in sequence.
RULES = [
    ("Apache-2.0", 100, ["apache-ref", "apache-obey", "apache-copy"]),
    ("Apache-2.0", 95, ["apache-ref"]),
    ("Apache-2.0", 90, ["apache-title"]),
    ("MIT", 100, ["mit-grant", "mit-warranty"]),
    ("MIT", 95, ["mit-ref"]),
    ("MIT", 80, ["mit-grant"]),
    ("ISC", 100, ["isc-grant"]),
    ("0BSD", 100, ["0bsd-grant"]),
    ("GPL-3.0-only", 95, ["gpl3-ref"]),
    ("CC-BY-NC-4.0", 95, ["cc-by-nc-ref"]),
    ("CC-BY-4.0", 95, ["cc-by-ref"]),
    ("BSD-3-Clause", 100, ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", 95, ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD", 80, ["bsd-redistribute"]),
    ("MPL-2.0", 100, ["mpl-subject", "mpl-copy"]),
    ("MPL-2.0", 95, ["mpl-subject"]),
    ("EPL-2.0", 100, ["epl-terms"]),
    ("BSL-1.0", 95, ["boost-ref"]),
    ("Zlib", 100, ["zlib-grant"]),
    ("Unlicense", 100, ["unlicense"]),
    ("CC0-1.0", 100, ["cc0-waive"]),
    ("all-rights-reserved", 50, ["rights"]),
]
#: Licences by the names that references use, with Public Licences of GNU written out below.
NAMES = {
    "Apache-2.0": ["Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD 2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD 3-Clause"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License Version 1.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "GPL-2.0-only": ["GNU General Public License v2.0", "GNU General Public License version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0-only": ["GNU General Public License v3.0", "GNU General Public License version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1-only": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License version 2.1", "LGPL-2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License v3.0", "GNU Affero General Public License version 3", "AGPLv3", "AGPL-3.0"],
}
#: Creative Commons licences by their terms.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: What stands round a licence's name where a text refers to it.
REFERENCES = [
    "Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "This project is licensed under the {}", "This software is licensed under the {}",
    "This work is licensed under the {}", "This work is licensed under a {}", "This work is licensed under {}", "This file is licensed under the {}", "This code is licensed under the {}", "License: {}", "Licence: {}",
]
SPDX = ["SPDX-License-Identifier: {}", "SPDX: {}"]
#: The GNU notices: licence stem, its words, versions.
GNU = [("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))]
GNU_NOTICE = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU_ONLY = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} version {} as published by the Free Software Foundation."


def standard_catalogue() -> tuple[dict[str, list[str]], list[tuple[str, int, list[str]]]]:
    """SENTENCES and RULES, with the references to licences by name and the GNU notices made from their forms."""
    known, rules = {k: list(v) for k, v in SENTENCES.items()}, list(RULES)

    def add(licence, score, identifier, forms):
        known.setdefault(identifier, []).extend(forms)
        rules.append((licence, score, [identifier]))

    for stem, words, versions in GNU:
        for v in versions:
            full = v if "." in v else f"{v}.0"
            later = "gpl-redistribute" if (stem, v) == ("GPL", "3") else f"{stem.lower()}{v}-redistribute"
            add(f"{stem}-{full}-or-later", 100, later, [GNU_NOTICE.format(x, words, y) for x in ("program", "library", "software", "file") for y in dict.fromkeys((v, full))])
            add(f"{stem}-{full}-only", 100, f"{stem.lower()}{v}-only", [GNU_ONLY.format(x, words, y) for x in ("program", "library", "software", "file") for y in dict.fromkeys((v, full))])
    names = dict(NAMES)
    for terms, words in CREATIVE.items():
        names[f"CC-{terms}-4.0"] = [f"CC {terms} 4.0", f"CC-{terms}-4.0", f"Creative Commons {words} 4.0 International License", f"Creative Commons {words} 4.0 International"]
    for licence, forms in names.items():
        add(licence, 95, f"{licence.lower()}-named", [r.format(x) for x in forms for r in REFERENCES])
        marked = [licence, *([licence.replace("-only", "-or-later"), licence.removesuffix("-only")] if licence.endswith("-only") else [])]
        for x in marked:
            add(x if x.endswith("-or-later") else licence, 100, f"{x.lower()}-spdx", [r.format(x) for r in SPDX])
        titles = [x for x in forms if " " in x]
        if titles:
            add(licence, 70, f"{licence.lower()}-title", titles)
    return known, rules


def catalogue_tables(spark, known: dict[str, list[str]] | None = None, rules: list | None = None) -> tuple[DataFrame, DataFrame]:
    """A catalogue as two tables: (identifier, sentence), and (pos, licence, confidence, identifiers)."""
    if known is None or rules is None:
        known, rules = standard_catalogue()
    s = spark.createDataFrame([(k, x) for k, v in known.items() for x in v], "identifier string, sentence string")
    return s, spark.createDataFrame([(n, *r) for n, r in enumerate(rules)], "pos int, licence string, confidence int, identifiers array<string>")


def read_catalogue(sentences_: DataFrame, rules_: DataFrame) -> tuple[dict[str, list[str]], list[tuple[str, int, list[str]]]]:
    """The catalogue of such tables. Its size is the caller's: it is sent to every task."""
    known: dict[str, list[str]] = {}
    for r in sentences_.select("identifier", "sentence").toLocalIterator():
        known.setdefault(r.identifier, []).append(r.sentence)
    return known, [(r.licence, r.confidence, list(r.identifiers)) for r in rules_.orderBy("pos").toLocalIterator()]


#: Sentences end at a line's end, or at . ! ? ; or : before white space.
CUT = re.compile(r"(?<=[.!?;:])\s+|[\r\n]+")
MARKS = re.compile(r"[^\w]+|_")


def normalised(sentence: str) -> str:
    """Compatibility forms composed, folded, comment marks and punctuation as one space."""
    return MARKS.sub(" ", unicodedata.normalize("NFKC", sentence).casefold()).strip()


def sentences(text: str) -> list[str]:
    return [s for s in CUT.split(text) if s and not s.isspace()]


class Catalogue:
    """Identifiers by normalised sentence, with the beginnings at which a cut may part one, and rules by first identifier."""

    def __init__(self, known: dict[str, list[str]], rules: list[tuple[str, int, list[str]]]):
        self.ids: dict[str, str] = {}
        self.heads: set[str] = set()
        for name, forms in known.items():
            for form in forms:
                whole = normalised(form)
                self.ids.setdefault(whole, name)
                self.heads.update(m.string[: m.end()] for m in re.finditer(r"\S+", whole))
        self.rules: dict[str, list[tuple[int, str, int, tuple[str, ...]]]] = {}
        for name in {x for _, _, run in rules for x in run} - set(known):
            raise ValueError(f"no sentence has the identifier {name}")
        for n, (licence, score, run) in enumerate(rules):
            self.rules.setdefault(run[0], []).append((n, licence, score, tuple(run)))

    def tagged(self, cut: list[str]) -> list[tuple[int, str]]:
        """Number of each licence sentence within a text's sentences, and its identifier.

        A licence sentence may go over several of them in a row, as where lines are wrapped; the longest counts. What is
        only marks, as a comment's empty line, lies between without effect.
        """
        found, k = [], 0
        norm = [normalised(s) for s in cut]
        while k < len(cut):
            so_far, end, name = norm[k], k, None
            i = k
            while so_far in self.heads:
                if so_far in self.ids:
                    end, name = i, self.ids[so_far]
                i += 1
                while i < len(cut) and not norm[i]:
                    i += 1
                if i == len(cut):
                    break
                so_far = f"{so_far} {norm[i]}"
            if name:
                found.append((k, name))
            k = end + 1
        return found

    def match(self, found: list[tuple[int, str]]) -> list[tuple[str, int, int, int]]:
        """Licence, confidence, first and last sentence of each match; a sentence serves one match, earlier rules first."""
        names, used, out = [n for _, n in found], [False] * len(found), []
        tries = sorted((r, i) for i, n in enumerate(names) for r in self.rules.get(n, ()))
        for (_, licence, score, run), i in tries:
            span = range(i, i + len(run))
            if span.stop <= len(names) and tuple(names[i : span.stop]) == run and not any(used[j] for j in span):
                for j in span:
                    used[j] = True
                out.append((licence, score, found[i][0], found[span.stop - 1][0]))
        return sorted(out, key=lambda x: (x[2], x[0]))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict | None = None, rules: list | None = None) -> DataFrame:
    """One row per input row: id, n_sentences, n_licence_sentences, n_matches, licences (distinct, in order, joined by a
    comma), sequence (identifiers in order, joined by a space), best_score.

    Null, empty and other texts without a licence sentence have empty strings, zero counts and best_score 0. A sentence that
    two rules claim serves the earlier one. Whole texts are read, batch by batch, without a shuffle; the catalogue is the
    only thing sent to the tasks, and its size is the caller's. Null ids and repeated rows pass through; an empty table
    gives an empty result. Columns other than the two are not read.
    """
    ship(docs.sparkSession)
    if known is None or rules is None:
        known, rules = standard_catalogue()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_sentences", "n_licence_sentences", "n_matches", "licences", "sequence", "best_score"]

    def run(batches):
        book = Catalogue(known, rules)
        for batch in slices(batches, 4_000_000):
            rows = []
            for text in batch.column(1).to_pylist():
                cut = sentences(text or "")
                tags = book.tagged(cut)
                hits = book.match(tags)
                rows.append((len(cut), len(tags), len(hits), ",".join(dict.fromkeys(h[0] for h in hits)), " ".join(n for _, n in tags), max((h[1] for h in hits), default=0)))
            cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_sentences bigint, n_licence_sentences bigint, n_matches bigint, licences string, sequence string, best_score int")


def op2_license_scan(spark, sf_dir):
    from .common import read

    return scan_licences(read(spark, sf_dir, "documents"))
