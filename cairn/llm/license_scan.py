"""License notices in documents: MinHash bands over overlapping windows retrieve templates, shingles verify them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import load, once

#: Public license notices by identifier.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "no-warranty-text": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
}


@dataclass(frozen=True)
class LicensePolicy:
    """Bands are of one MinHash each: two sets of similarity s share none of b bands with probability (1 - s) ** b. Each
    template has so many that of the windows that just reach ``containment`` at most a share of ``miss`` isn't retrieved."""

    miss: float = 1e-9
    shingle: int = 5
    containment: float = 0.8

    def bands(self, n: int, k: int, own: int) -> int:
        """For a template of n words with ``own`` different shingles of k words. A window is twice as long as its template
        and they overlap by half, so one of them has the whole of an exact notice, but n other shingles too: a notice of one
        shingle of five words has a similarity of 1/6, a long one of nearly 1/2, and less where only some shingles are shared."""
        shared = next(m for m in range(1, own + 1) if m / own >= self.containment or m == own)
        return max(1, math.ceil(math.log(self.miss) / math.log1p(-shared / (2 * n - k + 1 + own - shared))))


def words_in(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased: case and punctuation don't tell notices apart."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _shingles(words: str, size: int | str) -> str:
    """The shingles of an array of words, as SQL; none if there are fewer words than ``size``."""
    join = f"slice({words}, i + 1, {size})" if isinstance(size, str) else "array(" + ", ".join(f"get({words}, i + {k})" for k in range(size)) + ")"
    return f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> concat_ws(' ', {join})) ELSE array() END"


def _hashes(words: str, size: int) -> str:
    join = ", ".join(f"get({words}, i + {k})" for k in range(size))
    return f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64(concat_ws(' ', {join}))) ELSE array() END"


def prepare(spark: SparkSession, templates: dict[str, str], policy: LicensePolicy) -> list[Row]:
    """Per template: license, n (words), k (of its shingles: fewer than ``policy.shingle`` where it has fewer words), bands,
    own (its shingles), sketch (the least of each band's permutation of their hashes) and least (the hashes that are the
    least in some band). Templates without a word are refused."""
    words = {name: words_in(text) for name, text in sorted(templates.items())}
    if empty := [name for name, w in words.items() if not w]:
        raise ValueError(f"templates without a word: {empty}")
    sizes = {name: min(policy.shingle, len(w)) for name, w in words.items()}
    bands = {name: policy.bands(len(w), k := sizes[name], len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})) for name, w in words.items()}
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, w)).alias("w"), F.lit(len(w)).alias("n"), F.lit(sizes[name]).alias("k"), F.lit(bands[name]).alias("bands")) for name, w in words.items()])
    return (
        spark.range(1)
        .select(F.inline(rows))
        .selectExpr("*", f"array_distinct({_shingles('w', 'k')}) AS own")
        .selectExpr("license", "n", "k", "bands", "own", "transform(sequence(1, bands), b -> array_min(transform(own, s -> struct(xxhash64(b, xxhash64(s)) AS m, xxhash64(s) AS h)))) AS x")
        .selectExpr("license", "n", "k", "bands", "own", "x.m AS sketch", "array_distinct(x.h) AS least")
        .collect()
    )


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, policy: LicensePolicy = LicensePolicy(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, license, start, containment) for each row of ``docs`` and each window of it with a template; ``start`` is the
    window's first word. Null and empty texts have none; null ids are values; repeated rows have rows each; very long texts
    are scanned whole; an empty table gives none; other columns are not read. All is done within the row: no shuffle, one
    scan.

    A window can share a band with a template only if it has the shingle that is the template's least in that band. So
    the windows whose bands are compared are those about such shingles; for all others the bands are known to differ.
    A window that shares a band is verified by its shingles themselves."""
    known = prepare(docs.sparkSession, templates, policy)
    sizes = sorted({t.k for t in known})
    rows = docs.select(F.col(doc_id).alias("_id"), once(words_of(F.col(text))).alias("_w"))
    rows = rows.select("*", *[once(F.expr(_hashes("_w", k))).alias(f"_h{k}") for k in sizes])
    for k in sizes:
        least = ", ".join(f"{h}L" for h in sorted({h for t in known if t.k == k for h in t.least}))
        rows = rows.withColumn(f"_p{k}", F.expr(f"filter(transform(_h{k}, (h, i) -> CASE WHEN h IN ({least}) THEN i END), i -> i IS NOT NULL)"))
    by = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_h{k}").alias("h"), F.col(f"_p{k}").alias("p")) for k in sizes])
    rows = rows.select("_id", "_w", once(by).alias("_by")).filter(F.exists("_by", lambda x: F.size(x["p"]) > 0))
    listed = F.array(*[F.struct(*[(F.array(*map(F.lit, t[c])) if isinstance(t[c], list) else F.lit(t[c])).alias(c) for c in ("license", "n", "k", "bands", "own", "sketch")]) for t in known])
    each = (
        rows.select("_id", "_w", "_by", F.inline(listed))
        .selectExpr("*", "filter(_by, x -> x.k = k)[0] AS _x")
        .filter("size(_x.p) > 0")
        .selectExpr("_id", "_w", "_x.h AS _h", "license", "n", "k", "bands", "own", "sketch", "explode(array_distinct(flatten(transform(_x.p, p -> array(greatest(CAST(p div n AS INT) - 1, 0) * n, CAST(p div n AS INT) * n))))) AS start")
        .selectExpr("_id", "license", "own", "k", "bands", "start", "slice(_w, start + 1, 2 * n) AS _w", "sketch", "slice(_h, start + 1, 2 * n - k + 1) AS _h")
        .selectExpr("*", "transform(sequence(1, bands), b -> array_min(transform(_h, h -> xxhash64(b, h)))) AS _bands")
        .filter("exists(zip_with(_bands, sketch, (a, b) -> a <=> b), x -> x)")
        .selectExpr("_id", "license", "start", f"size(array_intersect(own, {_shingles('_w', 'k')})) / CAST(size(own) AS DOUBLE) AS containment")
        .filter(F.col("containment") >= policy.containment)
    )
    return each


def best(found: DataFrame) -> DataFrame:
    """Of each id and license the best window, of equals the first."""
    return found.groupBy("_id", "license").agg(F.max("containment").alias("containment"), F.min(F.struct(-F.col("containment"), F.col("start"))).alias("_m")).select("_id", "license", "containment", "_m.start")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best(scan(load(spark, sf_dir, "documents", "doc_id", "text")))
    return found.select(F.col("_id").alias("doc_id"), "license", F.round("containment", 6).alias("containment"), F.col("start").cast("long").alias("start_word"))


def sql_op2(templates: dict[str, str] = TEMPLATES) -> str:
    """Every window against every template by its shingles, without bands."""
    rows = []
    for name, text in sorted(templates.items()):
        words = words_in(text)
        k = min(5, len(words))
        own = sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
        rows.append(f"('{name}', {len(words)}, {k}, {own})")
    return f"""
WITH t(license, n, k, own) AS (VALUES {', '.join(rows)}
), d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents
), s AS (
  SELECT doc_id, license, n, k, own, w, unnest(range(0, len(w), n)) AS start FROM d, t
  WHERE len(list_filter(own, lambda o: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || o || ' '))) > 0
), v AS (
  SELECT doc_id, license, start, own, w[start + 1:start + 2 * n] AS x, k FROM s
), c AS (
  SELECT doc_id, license, start, len(list_intersect(own, list_transform(range(1, len(x) - k + 2), lambda i: array_to_string(x[i:i + k - 1], ' ')))) / len(own) AS containment FROM v WHERE len(x) >= k
)
SELECT doc_id, license, round(max(containment), 6) AS containment, arg_min(start, (-containment, start))::BIGINT AS start_word
FROM c WHERE containment >= 0.8 GROUP BY 1, 2
"""
