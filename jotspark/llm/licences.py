"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jotspark.llm.common import stored, table

#: Words of a shingle, permutations (bands of one row each), and the containment (per cent) from which a template is found.
WORDS, BANDS, PERCENT = 3, 64, 80
#: A window of two strides m holds any run of a template of up to m shingles. The template has over m / 2, so with a whole run the
#: Jaccard similarity is at least a quarter, and with PERCENT of it at least 0.4 m / 2.1 m = 0.19: one of 64 bands meets with odds
#: of 1 - 0.81^64 > 0.999998 at the least.
#: These are the strides of templates up to 256 shingles, as the SQL has them; longer ones go on by powers of two.
STRIDES = (2, 4, 8, 16, 32, 64, 128, 256)
#: Tables of up to so many numbers may be broadcast; beyond it the join is by shuffle.
SMALL = 2_000_000

# Public license notices.
TEMPLATES = [
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-short", "Released under the MIT License."),
    ("cc-by-nc-4.0-short", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("cc-by-4.0-short", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-short", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd-style-short", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "gpl-3-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
        'all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
        "do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
]


def shingled(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """The columns in keep, and sh: hashes of all runs of three words (lower-case ASCII letters and digits), in order; none for fewer.

    The words are bound by a lambda over one element, so that no rule of the optimiser splits the text once a shingle.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9]+", " ")), " ")

    def runs(w: Column) -> Column:
        n = F.size(w) - WORDS + 1
        all_runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WORDS)]))
        return F.when(n > 0, all_runs).otherwise(F.array().cast("array<bigint>"))

    return df.select(*keep, F.element_at(F.transform(F.array(words), runs), 1).alias("sh"))


def bands(window: Column) -> Column:
    """The smallest value of each permutation with its number."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.array_min(permuted(window, i)).alias("low")) for i in range(BANDS)])


def permuted(window: Column, i: int) -> Column:
    return F.transform(window, lambda h: F.xxhash64(h, F.lit(i)))


def templates(spark, rows: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """license, distinct shingles (t_sh) and stride of each template; rows: a list held in the program, or a table of license and body."""
    if not isinstance(rows, DataFrame):
        given = F.explode(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("body")) for a, b in rows])).alias("x")
        rows = spark.range(1).select(given).select("x.license", "x.body")
    t = shingled(rows, "body", F.col("license")).withColumn("t_sh", F.array_distinct("sh")).filter(F.size("t_sh") > 0)
    stride = F.greatest(F.lit(2), F.expr("shiftleft(1, length(bin(size(sh) - 1)))"))  # the least power of two that the length does not exceed
    return stored(t.select("license", "t_sh", stride.alias("stride")).coalesce(1))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """Returns id, license, n_windows, n_shared and n_template for each template of which some window of a text holds 80 per cent
    of the distinct 3-word shingles; n_shared is that of the best window, n_windows how many qualify.

    Windows of 2m shingles start every m shingles, m being the least power of two that a template's length does not exceed. Only
    windows that hold a shingle of some template are banded, which loses nothing: a window without one shares no band. Templates
    of fewer than three words hold no shingle and are never found, of any greater length they are; null, empty and short texts find nothing; rows of one id are
    taken together; an empty table, or an empty list of templates, gives none. What is looked up is joined by hash: the templates' shingles and bands
    are broadcast if they are few, else shuffled.
    """
    t = templates(docs.sparkSession, TEMPLATES if rows is None else rows)
    known = stored(t.select(F.explode("t_sh").alias("h")).distinct())
    strides = sorted(r[0] for r in t.select("stride").distinct().collect())  # powers of two
    if not strides:
        return docs.limit(0).select(F.col(id_col), F.lit("").alias("license"), *[F.lit(0).cast("long").alias(c) for c in ("n_windows", "n_shared", "n_template")])
    few = F.broadcast if known.count() <= SMALL else (lambda df: df)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shingles = shingled(texts, "text", F.col("rid")).select("rid", F.posexplode("sh").alias("at", "h"))
    hits = stored(shingles.join(few(known), "h", "left_semi").select("rid", "at"))
    ats = hits.groupBy("rid").agg(F.sort_array(F.collect_set("at")).alias("at"))  # of one text
    met = texts.join(F.broadcast(ats) if hits.count() <= SMALL else ats, "rid")
    wins = F.flatten(F.array(*[F.array_distinct(F.flatten(F.transform("at", both(m)))) for m in strides]))
    win = shingled(met, "text", F.col("id"), F.col("at")).select("id", "sh", F.explode(wins).alias("w")).filter("w.n >= 0")
    win = win.select(F.monotonically_increasing_id().alias("wid"), "id", F.col("w.stride").alias("stride"), F.col("w.n").alias("n"), F.expr("slice(sh, w.n * w.stride + 1, 2 * w.stride)").alias("sh"))
    win = stored(win)
    found = win.select("wid", "stride", F.explode(bands(F.col("sh"))).alias("b")).select("wid", "stride", "b.band", "b.low")
    index = t.select("license", "stride", F.explode(bands(F.col("t_sh"))).alias("b")).select("license", "stride", "b.band", "b.low")
    index = F.broadcast(index) if t.count() * BANDS <= SMALL else index
    met = stored(found.join(index, ["stride", "band", "low"]).select("wid", "license").distinct())
    pairs = win.join(F.broadcast(met) if met.count() <= SMALL else met, "wid").join(few(t.select("license", "t_sh")), "license")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("sh", "t_sh"))).filter(F.col("shared") * 100 >= PERCENT * F.size("t_sh"))
    one = pairs.groupBy("id", "license", "n").agg(F.max("shared").alias("shared"), F.max(F.size("t_sh")).alias("n_template"))
    out = one.groupBy("id", "license").agg(F.count("*").alias("n_windows"), F.max("shared").cast("long").alias("n_shared"), F.max("n_template").cast("long").alias("n_template"))
    return out.select(F.col("id").alias(id_col), "license", "n_windows", "n_shared", "n_template")


def both(m: int):
    def windows(i: Column) -> Column:
        n = F.floor(i / m).cast("int")
        return F.array(F.struct(F.lit(m).alias("stride"), n.alias("n")), F.struct(F.lit(m).alias("stride"), (n - 1).alias("n")))

    return windows


def op7_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


_ROWS = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in TEMPLATES)
_STRIDE = "CASE " + " ".join(f"WHEN len(w) - {WORDS - 1} <= {m} THEN {m}" for m in STRIDES) + " END"
ORACLE = f"""
WITH tw AS (SELECT license, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM (VALUES {_ROWS}) AS x(license, body)),
t AS (SELECT DISTINCT license, {_STRIDE} AS stride, unnest(list_transform(generate_series(1, len(w) - {WORDS - 1}), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM tw),
n AS (SELECT license, count(*) AS n_template FROM t GROUP BY license),
dw AS (SELECT doc_id, row_number() OVER () AS rid, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, rid, unnest(generate_series(0, len(w) - {WORDS})) AS i, unnest(list_transform(generate_series(1, len(w) - {WORDS - 1}), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM dw WHERE len(w) >= {WORDS}),
h AS (SELECT DISTINCT doc_id, license, i // stride - o AS n, t.s FROM d JOIN t ON d.s = t.s, (VALUES (0), (1)) AS v(o) WHERE i // stride - o >= 0),
c AS (SELECT doc_id, license, n, count(*) AS shared FROM h GROUP BY ALL)
SELECT doc_id, license, count(*) AS n_windows, max(shared) AS n_shared, any_value(n_template) AS n_template
FROM c JOIN n USING (license) WHERE shared * 100 >= {PERCENT} * n_template GROUP BY doc_id, license
"""
