"""Licence scan against brute force."""

import math
import random
import re
from collections import Counter

from fieldspan.llm.licenses import DENSITY, LICENCE_FILE, SIMILARITY, TEMPLATES, necessary_terms, scan, template_terms

FILES = "file_id long, path string, text string, score int, dir string, licence string"


def passages_of(low):
    found = {*low.split("\n"), *re.split(r"\n[ \t\r]*\n", low)}
    return found | {s for p in found for s in re.split(r"[.!?][ \t\r\n]+", p)}


def brute_force(files):
    docs = [set(re.split("[^a-z0-9]+", (t or "").lower())) if t is not None else set() for _, _, t in files]
    n = len(files)
    idf = {t: math.log((1 + n) / (1 + sum(t in d for d in docs))) + 1 for _, x in TEMPLATES for t in template_terms(x)}
    weight = lambda t: idf.get(t, math.log(1 + n) + 1)
    own = {}
    for key, _, text in files:
        low = (text or "").lower()
        for passage in passages_of(low):
            terms = Counter(t for t in re.split("[^a-z0-9]+", passage) if t)
            norm = math.sqrt(sum((c * weight(t)) ** 2 for t, c in terms.items()))
            for name, x in TEMPLATES:
                v = {t: c * idf[t] for t, c in template_terms(x).items()}
                cosine = sum(v.get(t, 0) * c * weight(t) for t, c in terms.items()) / norm / math.sqrt(sum(w * w for w in v.values())) if norm else 0
                if round(cosine, 6) >= SIMILARITY:
                    own[key] = min(own.get(key, (9,)), (-round(cosine, 6), -len(passage) / len(text), name))
    parts = lambda p: [x for x in p.split("/") if x]
    holders = {}
    for key, path, _ in files:
        if path is not None and key in own and (-own[key][1] >= DENSITY or re.search(LICENCE_FILE, path)):
            at = tuple(parts(path)[:-1])
            holders[at] = min(holders.get(at, (9,)), (own[key][0], path, own[key][2]))
    result = []
    for key, path, _ in files:
        mine = own.get(key)
        found = None
        if path is not None and not mine:
            at = parts(path)[:-1]
            found = next((("/".join(at[:k]), holders[tuple(at[:k])][2]) for k in range(len(at), -1, -1) if tuple(at[:k]) in holders), None)
        result.append((key, path, mine and mine[2], mine and -mine[0], mine[2] if mine else found and found[1], found and found[0]))
    return sorted(result, key=repr)


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(50)] + ["the", "of", "license", "under", "version"]
    files = []
    for i in range(250):
        path = "/".join(["src", rnd.choice("abc"), rnd.choice("xyz"), f"{i}.py"][rnd.randrange(3) :])
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 6))]
        if i % 5 == 0:
            lines.insert(rnd.randrange(len(lines) + 1), "# " + rnd.choice(TEMPLATES)[1])
        files.append((i, path, "\n".join(lines)))
    files += [(300, "src/a/LICENSE", "some more words about it all\n" * 30 + "Released under the MIT License."), (301, "COPYING", TEMPLATES[5][1]), (302, None, TEMPLATES[0][1])]
    files += [(303, "src//a/x/", "w1"), (304, "", "w1"), (305, "src/a/x/none.py", None), (306, "src/b/empty.py", ""), (307, "deep/" * 200 + "f.py", "w1"), (308, "src/b/wrapped.py", "permission is hereby granted, free of charge,\nto any person obtaining a copy of\nthis software and associated documentation files\n\nw1 w2")]
    files += [(309, "src/b/long.py", "word " * 60_000 + "license version"), (310, "src/b/twice.py", "w1"), (310, "src/b/twice.py", "w1")]
    result = scan(spark.createDataFrame([(*f, 1, "d", "l") for f in files], FILES))
    found = sorted((tuple(r) for r in result.select("file_id", "path", "own_licence", "own_score", "licence", "licence_dir").collect()), key=repr)
    assert found == brute_force(files)
    assert {r[5] for r in found if r[5] is not None} >= {"", "src/a"}


def test_empty(spark):
    assert scan(spark.createDataFrame([], FILES)).count() == 0


def test_terms_that_a_similar_passage_cannot_lack():
    v = {"a": 3.0, "b": 2.0, "c": 1.0}
    assert necessary_terms(v, 0.7) == {"a", "b"} - ({"b"} if math.sqrt(5) < 0.7 * math.sqrt(14) else set())
    for left_out in ({"a"}, {"a", "b"}):
        rest = math.sqrt(sum(w * w for t, w in v.items() if t not in left_out))
        assert (rest < 0.7 * math.sqrt(14)) == (necessary_terms(v, 0.7) <= left_out)


def test_a_notice_scores_alike_however_many_files_there_are(spark):
    notice = "This package is released under the MIT License."
    for n in (1_000, 20_000):
        files = [(i, f"d{i}/f", " ".join(["this package is the" if i % 5 < 3 else "w", notice if i == 0 else f"released under mit license x{i}" if i % 50 == 0 else "y"]) if i else notice, 1, "d", "l") for i in range(n)]
        found = {r.file_id: r.own_score for r in scan(spark.createDataFrame(files, FILES), all_terms=True).where("own_licence = 'MIT'").collect()}
        assert found.get(0, 0) > 0.75, n


def test_all_terms_weigh_by_their_files(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(12)] + ["the", "of", "license", "under"]
    files = [(i, f"a/{i}", "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))) + " " + (rnd.choice(TEMPLATES)[1] if rnd.random() < 0.3 else "") for _ in range(3)), 1, "d", "l") for i in range(150)]
    docs = [set(re.findall("[a-z0-9]+", f[2].lower())) for f in files]
    df = Counter(t for d in docs for t in d)
    weight = lambda t: math.log((1 + len(files)) / (1 + df[t])) + 1
    expected = {}
    for f in files:
        for passage in passages_of(f[2].lower()):
            terms = template_terms(passage)
            norm = math.sqrt(sum((c * weight(t)) ** 2 for t, c in terms.items()))
            for name, x in TEMPLATES:
                v = template_terms(x)
                dot = sum(v[t] * c * weight(t) ** 2 for t, c in terms.items() if t in v)
                cosine = round(dot / norm / math.sqrt(sum((c * weight(t)) ** 2 for t, c in v.items())), 6)
                if cosine >= SIMILARITY:
                    expected[f[0]] = min(expected.get(f[0], (9,)), (-cosine, -len(passage) / len(f[2]), name))
    rows = scan(spark.createDataFrame(files, FILES), all_terms=True).where("own_licence is not null").collect()
    assert {r.file_id: (-r.own_score, r.own_licence) for r in rows} == {i: (x[0], x[2]) for i, x in expected.items()} and len(rows) > 30


HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Copyright 2019 Some Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_usual_headers(spark):
    """Headers as they stand in files, plain and commented, among files without any; and texts that only sound like them."""
    commented = lambda text, mark: "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))
    probes = {
        "GPL-3.0": [HEADER, commented(HEADER, "#"), "/*\n" + commented(HEADER, " *") + " */\nint main;", HEADER.replace("\n", "\r\n")],
        "GPL-2.0": [HEADER.replace("version 3", "version 2")],
        "AGPL-3.0": [HEADER.replace("General Public", "Affero General Public")],
        "Apache-2.0": [APACHE, commented(APACHE, "//"), "# SPDX-License-Identifier: Apache-2.0\nimport os", "// spdx-license-identifier:Apache-2.0"],
        "MIT": ["Copyright (c) 2021 Jane Doe. Released under the MIT License.", "SPDX-License-Identifier: MIT"],
        "MPL-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"],
        "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."],
        "ISC": ["SPDX-License-Identifier: ISC"],
        None: ["free software is a program that the public may copy under a license", "SPDX-License-Identifier:", "the GNU project publishes a general license, version by version, and software", "the license", None, ""],
    }
    files = [(i, f"d{i}/f.py", text + ("\nimport nothing" if text else "") if text is not None else None, name) for i, (name, text) in enumerate((n, t) for n, ts in probes.items() for t in ts)]
    rnd = random.Random(3)
    words = ["the", "of", "and", "to", "in", "with", "is", "that", "under", "this"] + [f"w{k}" for k in range(400)]
    files += [(1000 + k, f"e{k}/f.py", " ".join(rnd.choice(words) for _ in range(60)), None) for k in range(200)]
    rows = scan(spark.createDataFrame([(i, p, t, 1, "d", "l") for i, p, t, _ in files], FILES), all_terms=True).collect()
    found = {r.file_id: r.own_licence for r in rows}
    assert found == {i: name for i, _, _, name in files}


def test_inheritance_with_all_terms(spark):
    """Nulls, empty, long and repeated rows, licence files by name and by density, when all terms weigh."""
    files = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "w1"), (3, "a/COPYING", HEADER), (4, "a/b/d.py", None), (5, None, "w1"), (6, "z/q.py", ""), (6, "z/q.py", "")]
    files += [(7, "a/b/own.py", "x " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (8, "a/b/e.py", "w2"), (9, "k/tag.txt", "SPDX-License-Identifier: ISC"), (10, "k/l/m.py", "w3")]
    rows = scan(spark.createDataFrame([(*f, 1, "d", "l") for f in files], FILES), all_terms=True).collect()
    found = sorted({(r.file_id, r.own_licence, r.licence, r.licence_dir) for r in rows})
    assert len(rows) == len(files) and found == [
        (1, "MIT", "MIT", None), (2, None, "GPL-3.0", "a"), (3, "GPL-3.0", "GPL-3.0", None), (4, None, "GPL-3.0", "a"), (5, None, None, None), (6, None, "MIT", ""),
        (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (8, None, "GPL-3.0", "a"), (9, "ISC", "ISC", None), (10, None, "ISC", "k"),
    ]
