"""License texts found by MinHash bands over overlapping windows, confirmed by exact shingle containment.

Everything is a column expression over one document: no Python rows, no join, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given, text_or_empty

# Names and wording of public license notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."),
}

WIDTH = 5
WORD_GAP = r"[^\p{L}\p{N}]+"
#: The four MinHash functions: least and greatest shingle hash, plain and after exclusive-or with this constant.
FLIP = 0x3C6EF372A54FF53A
#: Window sizes in shingles.  A template is looked up by the largest that is no longer than 0.8 of it.
WINDOWS = (1, 4, 16)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_GAP), "")


def shingles(of: Column) -> Column:
    """Hash of every run of ``WIDTH`` words, in order; fewer words make no shingle.

    Runs grow from pairs to fours to fives, each from two hashes of the step before.
    """
    def joined(left: Column, right: Column, ahead: int) -> Column:
        length = F.greatest(F.size(right) - ahead, F.lit(0))
        return F.zip_with(F.slice(left, F.lit(1), length), F.slice(right, F.lit(ahead + 1), length), lambda a, b: F.xxhash64(a, b))

    def fives(hashed: Column) -> Column:
        return F.transform(F.array(joined(hashed, hashed, 1)), lambda twos: F.transform(
            F.array(joined(twos, twos, 2)), lambda fours: joined(fours, hashed, WIDTH - 1))[0])[0]

    # One-element arrays hold each step, so that it is worked out once.
    return F.transform(F.array(F.transform(of, lambda w: F.xxhash64(w))), fives)[0]


def _window_minima(column: str, size: int, stride: int) -> str:
    """SQL text: least (lo) and greatest (hi) hash of windows of ``size`` shingles at every ``stride``-th place; a shorter text is one window."""
    windows = (f"transform(sequence(0, greatest(0, int(ceil((size({column}) - {size}) / {stride}.0))), 1), "
               f"i -> slice({column}, i * {stride} + 1, {size}))")
    return f"transform(array({windows}), ws -> struct(transform(ws, w -> array_min(w)) AS lo, transform(ws, w -> array_max(w)) AS hi))[0]"


def _size_class(shingle_count: int) -> int:
    return max(w for w in WINDOWS if w == 1 or w <= 0.8 * shingle_count)


def _indexed(spark, templates: dict[str, str]) -> list[dict]:
    """The templates' shingles and, for every window at every place, the minima: bounded by the template texts."""
    frame = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    frame = frame.select("name", shingles(words(F.col("text"))).alias("sh"))
    frame = frame.select("name", "sh", F.array_distinct("sh").alias("set"), F.expr(f"transform(sh, x -> x ^ {FLIP}L)").alias("sx"))
    rows = []
    for r in frame.select("name", "set", *[F.expr(_window_minima(c, size, 1)).alias(f"{c}{size}") for size in WINDOWS[1:] for c in ("sh", "sx")]).collect():
        minima = {(size, c, end): list(r[f"{c}{size}"][end]) for size in WINDOWS[1:] for c in ("sh", "sx") for end in ("lo", "hi")}
        rows.append({"name": r["name"], "set": list(r["set"]), "minima": minima | {(1, "sh", ""): list(r["set"])}})
    short = [r["name"] for r in rows if not r["set"]]
    if short:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    return rows


def _longs(values) -> Column:
    """A constant array: one text that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, sorted(set(values))))), ",").cast("array<bigint>")


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                    containment: float = 0.8) -> DataFrame:
    """``(id_col, license, matched, shingles, containment, first_word, last_word)``: one row per document and template found.

    Words are runs of letters and digits, lower-cased; a text's shingles are its runs of five words.  Windows of
    4 and 16 shingles overlap by half (single shingles for the shortest templates); a template's windows are
    indexed at every place.  A window that lies inside an unaltered stretch of the template shares all its
    minima with the index; a window of similarity 0.8 shares one of the four with probability
    1 - 0.2^4 = 0.998, and a notice spans several windows.  For the templates so retrieved the whole text's
    shingles are compared with the template's: reported when at least ``containment`` of them occur.
    ``first_word`` and ``last_word`` (from 0) bound the places of shared shingles.

    Null, empty and short texts match nothing.  Null ids and repeated rows are reported like others.
    Further columns are ignored.  An empty table gives an empty result.  The template set is
    configuration: its windows are literals of the plan.
    """
    index = _indexed(docs.sparkSession, templates or TEMPLATES)
    base = given(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("text"))
    hashed = base.select("id", words(F.col("text")).alias("w")).select("id", shingles(F.col("w")).alias("sh"))

    used = sorted({_size_class(len(r["set"])) for r in index})
    # A row mark in each step keeps the optimizer from moving the filter below it and working the arrays out anew there.
    mark = F.monotonically_increasing_id
    flipped = hashed.select("id", "sh", mark().alias("r1")).select("id", "sh", "r1", F.expr(f"transform(sh, x -> x ^ {FLIP}L)").alias("sx"), mark().alias("r2"))
    windowed = flipped.select("id", "sh", "r1", "r2", mark().alias("r3"), *[F.expr(_window_minima(c, s, s // 2)).alias(f"{c}{s}") for s in used if s > 1 for c in ("sh", "sx")])
    bands = [(1, "sh", "")] * (1 in used) + [(s, c, end) for s in used if s > 1 for c in ("sh", "sx") for end in ("lo", "hi")]
    known = {b: [v for r in index if _size_class(len(r["set"])) == b[0] for v in r["minima"][b]] for b in bands}

    def name(band) -> str:
        return "h_" + "_".join(map(str, band))

    hits = windowed.select("id", "sh", "r1", "r2", "r3", mark().alias("r4"), *[F.array_intersect(
        F.col("sh") if s == 1 else F.col(f"{c}{s}")[end], _longs(known[s, c, end])).alias(name((s, c, end))) for s, c, end in bands])
    hits = hits.filter("r1 >= 0 AND r2 >= 0 AND r3 >= 0 AND r4 >= 0 AND (" + " OR ".join(f"size({name(b)}) > 0" for b in bands) + ")")

    def retrieved(r) -> Column:
        found = F.lit(False)
        for b in bands:
            if b[0] == _size_class(len(r["set"])):
                found = found | F.arrays_overlap(F.col(name(b)), _longs(r["minima"][b]))
        return found

    def candidate(r) -> Column:
        whole = _longs(r["set"])
        return F.when(retrieved(r), F.struct(F.lit(r["name"]).alias("license"), F.lit(len(r["set"])).alias("shingles"),
                                             F.array_intersect(F.col("sh"), whole).alias("common")))

    found = hits.select("id", "sh", F.explode(F.filter(F.array(*[candidate(r) for r in index]), lambda c: c.isNotNull())).alias("c")) \
        .filter(F.size("c.common") >= F.col("c.shingles") * containment)
    first = F.array_min(F.transform("c.common", lambda v: F.array_position(F.col("sh"), v))) - 1
    last = F.size("sh") - F.transform(F.array(F.reverse("sh")), lambda back: F.array_min(F.transform("c.common", lambda v: F.array_position(back, v))))[0]
    return found.select(
        F.col("id").alias(id_col), F.col("c.license").alias("license"), F.size("c.common").cast("long").alias("matched"),
        F.col("c.shingles").cast("long").alias("shingles"), (F.size("c.common") / F.col("c.shingles")).alias("containment"),
        first.cast("long").alias("first_word"), (last + WIDTH - 1).cast("long").alias("last_word"))


def template_values() -> str:
    """The templates as SQL rows, for the twin query."""
    return ", ".join("('{}', '{}')".format(n, re.sub("'", "''", t)) for n, t in sorted(TEMPLATES.items()))
