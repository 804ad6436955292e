"""Licence scans with DataFrame functions only: TF-IDF cosine to templates, then the nearest ancestor directory's licence."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.llm.common import Stages, restrict

#: Cosine from which a passage is a notice of the template's licence.
SIMILARITY = 0.7
#: Share of a file's characters from which its notice makes it a licence file.
DENSITY = 0.3
#: Files of these names are licence files if they hold a notice at all.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"

# Notices, sentences and whole headers as they stand at the head of files or in licence files.
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
    "You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.",
)
_GNU_LICENCES = (
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE[0]),
    ("Apache-2.0", " ".join(_APACHE)),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    *((licence, _GNU[0].format(name=name, version=version)) for licence, name, version in _GNU_LICENCES),
    *((licence, " ".join(_GNU).format(name=name, version=version)) for licence, name, version in _GNU_LICENCES),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: A tag that names the licence outright, and how a file is known to have one.
TAG, TAGGED = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)", "spdx-license-identifier:"

_BREAKS = "[^a-z0-9]+"


def template_terms(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", text.lower()))


def term_idf(files: DataFrame, templates=TEMPLATES, text: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all files, and that of a term in no file.

    ln((1 + files) / (1 + files with the term)) + 1. At most one row per template term
    reaches the driver. For terms outside the templates see ``other_frequencies``.
    """
    vocabulary = sorted({t for _, x in templates for t in template_terms(x)})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(F.lower(text), _BREAKS))
    rows = files.select(F.explode(F.concat(F.coalesce(held, F.array().cast("array<string>")), F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    found = {r["term"]: r["count"] for r in rows}
    n = found.pop("", 0)  # every file once
    return {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + n) + 1


def other_frequencies(files: DataFrame, terms: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """(term, files): in how many files each term of ``terms`` occurs that is not in the vocabulary. Runs jobs: both tables are staged.

    Terms of all texts are taken apart, and only those asked for are counted before they move.
    """
    stages = Stages(files.sparkSession)
    wanted = stages.keep(terms.select("term").where(~F.col("term").isin(vocabulary)).distinct(), "wanted")
    held = files.select(F.explode(F.array_distinct(F.split(F.lower(text), _BREAKS))).alias("term"))
    counts = stages.keep(restrict(held, wanted, "term").groupBy("term").agg(F.count("*").alias("files")), "counts")
    stages.drop("wanted")
    return counts


def necessary_terms(vector: dict[str, float], similarity: float) -> set[str]:
    """The heaviest terms, so many that what is left of the vector is shorter than ``similarity`` of it.

    A passage without any of them has a smaller cosine, whatever else it holds.
    """
    whole = sum(w * w for w in vector.values())
    rest, chosen = whole, set()
    for term in sorted(vector, key=lambda t: (-vector[t], t)):
        if rest < similarity**2 * whole * (1 - 1e-9):
            break
        chosen.add(term)
        rest -= vector[term] ** 2
    return chosen


def own_notices(
    files: DataFrame, *, key: str = "file_id", text: str = "text", templates=TEMPLATES, similarity: float = SIMILARITY, all_terms: bool = False
) -> DataFrame:
    """(key, licence, score, share) of files with a notice: the best passage of the whole text.

    Passages are lines, paragraphs (between blank lines), and the sentences of either, so a notice behind a
    line of copyright is found; comment marks are no terms. The first SPDX tag is a notice of score 1. Ties go to the longer share, then to the
    smaller licence name. ``share`` is the passage's part of the text's characters. With ``all_terms`` every term of a passage weighs by
    its frequency over all files (runs jobs); without it, terms outside the templates weigh as if in no file,
    which lowers the scores of one notice as files become more.
    """
    idf, unseen = term_idf(files, templates, text)
    vectors = [(name, {t: n * idf[t] for t, n in template_terms(x).items()}) for name, x in templates]
    needed = sorted(set().union(*(necessary_terms(v, similarity) for _, v in vectors)))
    pattern = r"\b(?:" + "|".join(needed) + r")\b"

    low = F.lower(text)
    passages = F.array_union(F.split(low, "\n"), F.split(low, r"\n[ \t\r]*\n"))
    passages = F.filter(passages, lambda p: p.rlike(pattern))
    sentences = F.flatten(F.transform(passages, lambda p: F.split(p, r"[.!?][ \t\r\n]+")))
    passages = F.array_union(passages, F.filter(sentences, lambda p: p.rlike(pattern)))
    near = _near_passages(passages, idf, 1.0 if all_terms else unseen, vectors, similarity)
    found = files.where(low.rlike(pattern)).select(key, F.length(text).alias("chars"), F.explode(near).alias("passage"))
    found = found.withColumn("share", F.length("passage") / F.col("chars")).drop("chars")
    if all_terms:
        found = Stages(files.sparkSession).keep(found, "found")
    # Equal passages are scored once: a notice that a third of all files share is one row here.
    terms = found.select("passage").distinct().select("passage", F.explode(F.split("passage", _BREAKS)).alias("term")).where("term <> ''")
    terms = terms.groupBy("passage", "term").count()
    weights = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
    if all_terms:
        terms = terms.join(other_frequencies(files, terms, sorted(idf), text), "term", "left")
        other = F.coalesce(F.lit(unseen) - F.log1p(F.col("files").cast("double")), F.lit(unseen))
    else:
        other = F.lit(unseen)
    terms = terms.withColumn("weight", F.col("count") * F.coalesce(F.try_element_at(weights, F.col("term")), other))
    dots = [F.sum(_by_term(v) * F.col("weight")).alias(f"dot{i}") for i, (_, v) in enumerate(vectors)]
    sums = terms.groupBy("passage").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), *dots)
    names = sorted({name for name, _ in vectors})
    scores = [
        F.struct(F.round(F.col(f"dot{i}") / F.col("norm") / math.sqrt(sum(w * w for w in v.values())), 6).alias("score"), F.lit(-names.index(name)).alias("place"))
        for i, (name, v) in enumerate(vectors)
    ]
    scored = sums.select("passage", F.array_max(F.array(*scores)).alias("best")).where(F.col("best.score") >= similarity)
    scored = scored.select("passage", "best.score", F.element_at(F.array(*map(F.lit, names)), 1 - F.col("best.place")).alias("licence"))
    tagged = files.where(low.contains(TAGGED)).select(key, F.regexp_extract(text, TAG, 1).alias("licence"), F.length(F.regexp_extract(text, TAG, 0)).alias("n"), F.length(text).alias("chars"))
    tagged = tagged.where("licence <> ''").select(key, F.lit(1.0).alias("score"), (F.col("n") / F.col("chars")).alias("share"), "licence")
    scored = found.join(scored, "passage").select(key, "score", "share", "licence").union(tagged)
    own = scored.groupBy(key).agg(F.min(F.struct(-F.col("score"), -F.col("share"), "licence")).alias("best"))
    return own.select(key, F.col("best.licence"), (-F.col("best.col1")).alias("score"), (-F.col("best.col2")).alias("share"))


def _near_passages(passages: Column, idf: dict[str, float], least: float, vectors: list[tuple[str, dict[str, float]]], similarity: float) -> Column:
    """The passages whose cosine to some template may reach ``similarity``, found within the row.

    The template's terms in a passage are counted exactly. Other words add at least the
    square of the ``least`` weight each to the passage's norm (1 is that of a term in every file), so the cosine is no
    larger than with that norm: a text that only mentions a few terms never leaves its row.
    """

    def table(weights: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for t in sorted(weights) for x in (t, weights[t])])

    def total(counts: Column, weight) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + weight(c["term"], c["n"].cast("double")))

    vocabulary, weights = F.array(*map(F.lit, sorted(idf))), table(idf)
    split = F.transform(passages, lambda p: F.struct(p.alias("passage"), F.filter(F.split(p, _BREAKS), lambda t: t != "").alias("terms")))

    def counted(p: Column) -> Column:
        n = lambda t: F.size(F.filter(p["terms"], lambda x: x == t))
        held = F.transform(F.array_intersect(vocabulary, p["terms"]), lambda t: F.struct(t.alias("term"), n(t).alias("n")))
        return F.struct(p["passage"].alias("passage"), F.size(p["terms"]).alias("size"), held.alias("counts"))

    def may_reach(p: Column) -> Column:
        known = total(p["counts"], lambda t, n: F.pow(n * F.element_at(weights, t), F.lit(2.0)))
        others = p["size"] - total(p["counts"], lambda t, n: n)
        norm = F.sqrt(known + least * least * others)
        cosines = []
        for _, v in vectors:
            own, length = table(v), math.sqrt(sum(w * w for w in v.values()))
            dot = total(p["counts"], lambda t, n, own=own: n * F.element_at(weights, t) * F.coalesce(F.try_element_at(own, t), F.lit(0.0)))
            cosines.append(dot / length)
        return F.greatest(*cosines) >= (similarity - 1e-5) * norm

    return F.transform(F.filter(F.transform(split, counted), may_reach), lambda p: p["passage"])


def _by_term(vector: dict[str, float]) -> Column:
    choice = F.lit(0.0)
    for term, weight in sorted(vector.items()):
        choice = F.when(F.col("term") == term, F.lit(weight)).otherwise(choice)
    return choice


def ancestors(directory: Column) -> Column:
    """The directory and all above it, as structs of depth and directory; the root is empty and of depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))


def scan(
    files: DataFrame, *, key: str = "file_id", path: str = "path", text: str = "text", templates=TEMPLATES, similarity: float = SIMILARITY, density: float = DENSITY,
    all_terms: bool = False,
) -> DataFrame:
    """One row per file: key, path, own_licence, own_score, licence, licence_dir.

    A file's own notice decides; else the licence of the nearest directory at or above the
    file's that has a licence file. A directory's licence is that of its licence file of the
    best score, ties to the smaller path and licence; directories above only count where none is nearer. Licence
    files are files with a notice that are named so or consist of it to ``density``.

    Null or empty texts have no notice; null paths inherit nothing and make no licence file. Rows
    repeating a key share their best notice. Paths are joined as directories, each distinct one
    once, so a directory with many files is one row until its files look up the result.
    """
    stages = Stages(files.sparkSession)
    slim = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    own = stages.keep(own_notices(slim, key="key", templates=templates, similarity=similarity, all_terms=all_terms), "own")
    normal = F.array_join(F.filter(F.split("path", "/"), lambda p: p != ""), "/")
    placed = slim.select("key", "path", F.regexp_replace(normal, "/?[^/]*$", "").alias("dir"))

    noticed = placed.join(own, "key")
    holders = noticed.where((F.col("share") >= density) | F.col("path").rlike(LICENCE_FILE)).where("path is not null")
    per_dir = holders.groupBy("dir").agg(F.min(F.struct(-F.col("score"), "path", "licence")).alias("best")).select(F.col("dir").alias("above"), F.col("best.licence").alias("licence"))
    dirs = placed.select("dir").where("dir is not null").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = dirs.join(per_dir, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "licence")).alias("n"))
    nearest = stages.keep(nearest.select("dir", F.col("n.above").alias("licence_dir"), F.col("n.licence").alias("inherited")), "nearest")

    result = placed.join(own.select("key", F.col("licence").alias("own_licence"), F.col("score").alias("own_score")), "key", "left").join(nearest, "dir", "left")
    return result.select(
        F.col("key").alias(key),
        F.col("path").alias(path),
        "own_licence",
        "own_score",
        F.coalesce("own_licence", "inherited").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("licence_dir")).alias("licence_dir"),
    )
