"""License scan: MinHash bands over overlapping text windows find templates, shingle containment verifies them.

Everything is DataFrame functions.  Words become hashes of five-word shingles.
Templates are grouped by size; a group scans windows of 1.25 times its largest
template at steps of a quarter of it, so every occurrence lies whole in one window
and makes up 0.4 or more of it, or 0.32 when a fifth of it was changed.  With 32
bands of one row the chance to miss such a window is below 0.68^32 < 0.00001.

A band of a window can equal that of a template only if the window holds the
template's smallest shingle of the band, so texts and windows without any shingle
of a template are left out before their bands are computed; this loses nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluoroframe.llm.common import filled, once

SHINGLE = 5
BANDS = 32
CONTAINMENT = 0.8
#: Most templates and template shingles; both are sent to every task.
MOST_TEMPLATES, MOST_SHINGLES = 2000, 200_000

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "ISC-header": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def _with_shingles(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Hashes of the word shingles of a text, in order."""
    words, count = F.col("_words"), F.size("_words") - (SHINGLE - 1)
    one = lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(SHINGLE)])
    made = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), one)).otherwise(F.array().cast("array<long>"))
    cut = once(rows, "_words", F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1)))
    return once(cut.drop(text), out, made).drop("_words")


def _bands(shingles: Column) -> Column:
    def low(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[low(k) for k in range(BANDS)])


def size_class(shingles: int) -> tuple[int, int]:
    """Window length and step, in shingles, for templates of so many shingles."""
    top = 1 << max(0, (shingles - 1).bit_length())
    step = max(1, top // 4)
    return top + step - 1, step


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Per document and license found in it: id, ``license``, ``containment`` (best share of the template's shingles in
    one window) and ``word_start`` (word, from 0, at which the first such window opens).

    Whole texts count.  Null, empty and short texts hold no license; rows with the same id, null ids too, count as one
    document; other columns are left behind.  Templates need five words or more.
    """
    spark: SparkSession = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    given = spark.createDataFrame(list(templates.items()) or [("", "")], "license string, text string")
    known = once(_with_shingles(given, "text", "_all"), "shingles", F.array_distinct("_all")).drop("_all")
    sizes = {r["license"]: r["shingles"] for r in known.collect()}  # at most MOST_TEMPLATES fixed texts
    if templates and min(map(len, sizes.values())) == 0:
        raise ValueError(f"templates need {SHINGLE} words or more")
    wanted = sorted({h for hs in sizes.values() for h in hs})
    if len(wanted) > MOST_SHINGLES:
        raise ValueError(f"at most {MOST_SHINGLES} template shingles")
    classes = sorted({size_class(len(hs)) for hs in sizes.values()})
    of_class = F.create_map(*[x for name, hs in sizes.items() for x in (F.lit(name), F.lit(size_class(len(hs))[0]))])
    bands = known.select("license", "shingles", of_class[F.col("license")].alias("length"), F.posexplode(_bands(F.col("shingles"))).alias("band", "low"))

    any_known = F.array(*[F.lit(h).cast("long") for h in wanted]) if wanted else F.array().cast("array<long>")
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), filled(text_column).alias("_text"))
    marked = _with_shingles(rows, "_text", "_h").where(F.arrays_overlap("_h", any_known))

    def opens(length: int, step: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("_h"), F.lit(step)), lambda at: F.struct(F.lit(length).alias("length"), at.alias("at")))

    places = [opens(length, step) for length, step in classes]
    opened = marked.select("_id", "_h", F.explode_outer(reduce(lambda a, b: F.concat(a, b), places)).alias("w"))
    windows = once(opened, "win", F.slice("_h", F.col("w.at"), F.col("w.length"))).select("_id", "w.length", "w.at", "win")
    windows = windows.where(F.arrays_overlap("win", any_known))
    signed = windows.select("_id", "length", "at", "win", F.posexplode_outer(_bands(F.col("win"))).alias("band", "low"))
    # at most MOST_TEMPLATES x BANDS rows, checked above
    found = signed.join(F.broadcast(bands), ["length", "band", "low"])
    share = F.size(F.array_intersect("win", "shingles")) / F.size("shingles")
    sure = found.select("_id", "license", "at", share.alias("share")).where(F.col("share") >= containment)
    out = sure.groupBy("_id", "license").agg(F.max("share").alias("containment"), (F.min("at") - 1).cast("long").alias("word_start"))
    return out.withColumnRenamed("_id", id_column)


def scan_sql() -> str:
    """The same by exact containment in every window, for DuckDB over ``documents``."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
    shingles = "[array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]"
    return f"""
WITH t0(license, text) AS (VALUES {quoted}),
t1 AS (SELECT license, list_distinct({shingles}) AS ss FROM (SELECT license, {words.format('text')} AS ws FROM t0)),
t AS (SELECT license, unnest(ss) AS s, len(ss) AS n, CAST(greatest(1, pow(2, ceil(log2(len(ss)))) // 4) AS BIGINT) AS step,
             CAST(pow(2, ceil(log2(len(ss)))) AS BIGINT) AS top FROM t1),
d AS (SELECT doc_id, unnest({shingles}) AS s, unnest(range(0, len(ws) - 4)) AS pos
      FROM (SELECT doc_id, {words.format("coalesce(text, '')")} AS ws FROM documents)),
m AS (SELECT doc_id, license, n, s, unnest(range(greatest(0, pos - top + 1) // step, pos // step + 1)) * step AS wat
      FROM d JOIN t USING (s)),
w AS (SELECT doc_id, license, wat, count(DISTINCT s) / any_value(n) AS share FROM m GROUP BY ALL)
SELECT doc_id, license, max(share) AS containment, CAST(min(wat) AS BIGINT) AS word_start
FROM w WHERE share >= {CONTAINMENT} GROUP BY doc_id, license"""
