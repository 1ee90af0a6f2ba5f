"""License scans in DataFrame functions only: MinHash bands over overlapping text windows.

Templates are grouped by length.  Each length class has windows of twice its stride, one every
stride words, so a passage of a template's length (and a fifth more) lies whole in some window.
Bands are of one row each; their number is chosen so that a window holding the least accepted
share of any template meets it in some band with probability ``RECALL``.  Candidates are then
decided by exact containment: the share of the template's own shingles in the window.

Two exact filters spare work, and none of them can lose a match.  Every template shingle holds
at least one word of a small cover (chosen greedily from the templates), so only texts with a
cover word, and of these only windows with as many of them as the accepted share needs, are hashed.

Defined results: null and empty texts match nothing; a template needs five words or more;
repeated rows are reported once each; null ids are kept.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED, RECALL = 5, 0.8, 0.999

#: Public license notices.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License."""),
    ("MIT", "notice", "Released under the MIT License"),
    ("MIT", "grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version."""),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0"),
    ("BSD", "terms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met"""),
    ("ISC", "grant", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
]

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [word for word in re.split(_BREAK, lowered) if word]


@dataclass(frozen=True)
class LengthClass:
    stride: int
    #: (license, template, distinct shingles of the template)
    templates: tuple[tuple[str, str, tuple[str, ...]], ...]

    @property
    def width(self) -> int:
        return 2 * self.stride

    @property
    def least_shared(self) -> int:
        """Shingles that a match of any template of the class has in common with its window."""
        return min(math.ceil(CONTAINED * len(shingles) - 1e-9) for _, _, shingles in self.templates)

    @property
    def least_jaccard(self) -> float:
        return min(math.ceil(CONTAINED * len(s) - 1e-9) / (self.width - SHINGLE + 1 + len(s) - math.ceil(CONTAINED * len(s) - 1e-9))
                   for _, _, s in self.templates)


def length_classes(templates: list[tuple[str, str, str]]) -> list[LengthClass]:
    """Classes whose strides are powers of two or three halves of them, at least a fifth over the template's length."""
    by_stride: dict[int, list] = {}
    for license_name, template, text in templates:
        words = words_of(text)
        if len(words) < SHINGLE:
            raise ValueError(f"a template needs {SHINGLE} words: {license_name} {template}")
        needed = math.ceil(1.2 * len(words))
        stride = min(s for power in range(2, 20) for s in (1 << power, 3 << power - 1) if s >= needed)
        shingles = {" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        by_stride.setdefault(stride, []).append((license_name, template, tuple(sorted(shingles))))
    return [LengthClass(stride, tuple(found)) for stride, found in sorted(by_stride.items())]


def bands_for(classes: list[LengthClass]) -> int:
    least = min(c.least_jaccard for c in classes)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - least))


def cover(classes: list[LengthClass]) -> list[str]:
    """Few words such that every template shingle holds one of them.

    Words of more than four letters serve as far as they reach: shorter ones are in most texts.
    """
    left = {s for c in classes for _, _, shingles in c.templates for s in shingles}
    chosen = []
    while left:
        counts: dict[str, int] = {}
        for word in (word for shingle in left for word in set(shingle.split())):
            counts[word] = counts.get(word, 0) + 1
        chosen.append(max(counts, key=lambda word: (len(word) > 4, counts[word], len(word), word)))
        left = {s for s in left if chosen[-1] not in s.split()}
    return chosen


def _minima(shingles: Column, bands: int) -> Column:
    """One minimum per band; a band's number is its seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda band: F.array_min(
        F.transform(shingles, lambda s: F.xxhash64(s, band))))


def _shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def windows(documents: DataFrame, classes: list[LengthClass], id_column: str, text_column: str) -> DataFrame:
    """(row, doc_id, stride, start, words): the windows that hold enough cover words."""
    known = cover(classes)
    text, held = F.col(text_column).cast("string"), F.array(*[F.lit(word) for word in known])
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = (documents.where(text.rlike("(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, known)) + ")(?![a-z0-9])"))
             .select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"),
                     F.filter(F.split(lowered, _BREAK), lambda word: word != "").alias("words")))
    spots = texts.withColumn("spots", F.filter(
        F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(held, F.get(F.col("words"), i))))
    spots = spots.where((F.size("spots") > 0) & (F.size("words") >= SHINGLE))

    def cut(c: LengthClass) -> Column:
        needed = math.ceil(c.least_shared / SHINGLE)  # one word is in five shingles at most
        found = F.flatten(F.transform("spots", lambda p: F.array(F.floor(p / c.stride), F.floor(p / c.stride) - 1)))
        starts = F.transform(F.filter(F.array_distinct(found), lambda k: k >= 0), lambda k: (k * c.stride).cast("int"))
        enough = F.filter(starts, lambda start: F.size(F.filter(
            F.col("spots"), lambda p: (p >= start) & (p < start + c.width))) >= needed) if needed > 1 else starts
        return F.transform(enough, lambda start: F.struct(
            F.lit(c.stride).alias("stride"), start.alias("start"), F.slice("words", start + 1, c.width).alias("words")))

    return (spots.select("row", "doc_id", F.explode(F.concat(*[cut(c) for c in classes])).alias("window"))
            .select("row", "doc_id", "window.*").where(F.size("words") >= SHINGLE))


def license_scan(documents: DataFrame, templates: list[tuple[str, str, str]] | None = None, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """(doc_id, license, template, contained, first_word): the best window of each template met in a document.

    ``contained`` is the share of the template's shingles in that window, ``first_word`` where the
    earliest such window begins.
    """
    spark, classes = documents.sparkSession, length_classes(templates or TEMPLATES)
    bands = bands_for(classes)
    listed = spark.createDataFrame(
        [(c.stride, name, template, list(shingles)) for c in classes for name, template, shingles in c.templates],
        "stride int, license string, template string, wanted array<string>")
    known = listed.select("*", F.posexplode(_minima(F.col("wanted"), bands)).alias("band", "least"))
    met = windows(documents, classes, id_column, text_column).select(
        "row", "doc_id", "stride", "start", _shingles(F.col("words")).alias("shingles"))
    banded = met.select("*", F.posexplode(_minima(F.col("shingles"), bands)).alias("band", "least"))
    decided = (banded.join(F.broadcast(known), ["stride", "band", "least"])  # the templates are a fixed list
               .withColumn("contained", F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted"))
               .where(F.col("contained") >= CONTAINED))
    best = (decided.groupBy("row", "doc_id", "license", "template")
            .agg(F.max("contained").alias("contained"), F.min_by("start", F.struct(-F.col("contained"), F.col("start"))).alias("first_word")))
    return best.select("doc_id", "license", "template", "contained", F.col("first_word").cast("long").alias("first_word"))
