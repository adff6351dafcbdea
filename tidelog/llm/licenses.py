"""License scans with built-in functions only: MinHash bands retrieve templates, exact containment verifies.

Words are runs of a-z and 0-9 after lower-casing; shingles are five words (a text with fewer words, but
not none, is one shingle). A template is found in a text if at least 0.8 of its distinct shingles occur in it.

Candidates. Texts are covered by overlapping windows of 1, 2, 4 and 16 shingles, at every 1, 1, 2 and 8
shingles; a template uses the width that its length allows (`WIDTHS`: from so many shingles on), with all its
windows of that width, at every place. So whatever the place of a copy, one of the text's windows lies in it
and equals a window of the template, and all its bands agree: with an unaltered run as long as the least
length of its width, a template is retrieved with certainty. Otherwise a band agrees with a
probability of the windows' similarity s, and of b bands one does with 1 - (1 - s)^b. A band is one
row: the window's least shingle in one order of the hashes. Two orders are the hash's own and its reverse,
two more those of the hash with its bits flipped by a mask; narrow windows use one or two of them.

Before that, texts that cannot hold any template are set aside. Of each template a few words are taken such
that fewer than 0.8 of its shingles are without any of them; a text with none of these words can't have enough
of its shingles. This loses nothing. A short list is sought in the text as it comes, also inside other words; a
longer one among the text's words. With more than MOST_TEMPLATES templates, all texts go through the windows.

Null texts and texts without words have no shingles and no match. Repeated rows are scanned each on its
own. Templates without words are never found; no templates or no texts: no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import only

SHINGLE, CONTAINED = 5, 0.8
#: width -> (stride over texts, least number of shingles of a template, bands)
WIDTHS = {1: (1, 1, 1), 2: (1, 2, 1), 4: (2, 5, 2), 16: (8, 23, 4)}
FLIP = 0x5A5A5A5A5A5A5A5A
#: Template band keys up to this number are broadcast (20 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Templates that are looked through for words that a text must have; a list of those up to this length is sought in unsplit texts.
MOST_TEMPLATES, MOST_ANCHORS = 1000, 24

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
}

# Further notices and short licenses; the whole texts of longer ones are the files of license_texts.
NOTICES = {
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1-or-later-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "AGPL-3.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public "
        "License for more details."
    ),
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
}


def whole_templates() -> dict[str, str]:
    """TEMPLATES, NOTICES, and the whole texts of license_texts by the names of the files."""
    texts = {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return TEMPLATES | NOTICES | {f"{name}-text": text for name, text in texts.items()}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _hashed(rows: DataFrame) -> DataFrame:
    """rows (..., words) with `shingles`, their hashes; each step is a projection of its own, so nothing is worked out twice."""
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    h, n = F.col("hashes"), F.size("words")
    five = F.transform(F.slice(h, 1, F.greatest(n - SHINGLE + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SHINGLE))))
    few = F.when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("shingles", F.when(n >= SHINGLE, five).otherwise(few)).drop("hashes")


def _bands(shingles: Column, flipped: Column, width: int, stride: int, bands: int) -> list[Column]:
    """One array of band keys for each band."""
    n = F.size(shingles)
    if width == 1:
        return [shingles]
    none = F.array().cast("array<bigint>")
    if width == 2 and stride == 1:
        pairs = F.transform(F.slice(shingles, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.least(x, F.get(shingles, i + 1)))
        return [F.when(n > 1, pairs).otherwise(none)]
    starts = F.sequence(F.lit(1), n - width + 1, F.lit(stride))

    def band(column: Column, least) -> Column:
        return F.when(n >= width, F.transform(starts, lambda i: least(F.slice(column, i, width)))).otherwise(none)

    orders = [(shingles, F.array_min), (shingles, F.array_max), (flipped, F.array_min), (flipped, F.array_max)]
    return [band(*order) for order in orders[:bands]]


def _with_flipped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("flipped", F.transform("shingles", lambda x: x.bitwiseXOR(F.lit(FLIP))))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license, text) of the templates."""
    rows = list((TEMPLATES if templates is None else templates).items())
    return spark.createDataFrame(rows, "license string, text string")


def template_keys(templates: DataFrame) -> DataFrame:
    """(key, license): the band keys of all windows of a template's width."""
    rows = _with_flipped(_hashed(templates.select("license", words(F.col("text")).alias("words"))))
    n = F.size(F.array_distinct("shingles"))
    s, f = F.col("shingles"), F.col("flipped")
    keys = F.array().cast("array<bigint>")
    for width, (_, least, bands) in WIDTHS.items():
        keys = F.when(n >= least, F.concat(*_bands(s, f, width, 1, bands))).otherwise(keys)
    return rows.select("license", F.explode(F.array_distinct(keys)).alias("key"))


def anchors(templates: list[str], inside: bool = True) -> list[str]:
    """Words of which a text has at least one (as a word or, if `inside`, within one) if it has 0.8 of the shingles of any of the templates."""
    chosen: list[str] = []
    has = (lambda s, a: any(a in w for w in s)) if inside else (lambda s, a: a in s)
    for text in templates:
        own = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        shingles = {tuple(own[i : i + SHINGLE]) for i in range(max(1, len(own) - SHINGLE + 1))} if own else set()
        need, words_here = math.ceil(CONTAINED * len(shingles)), set(own)
        known = chosen if inside else [a for a in chosen if a in words_here]
        without = [s for s in shingles if not any(has(s, a) for a in known)]
        for word in sorted(words_here, key=lambda w: (-len(w), w)):
            if len(without) < need:
                break
            fewer = [s for s in without if not has(s, word)]
            if len(fewer) < len(without):
                chosen.append(word)
                without = fewer
    return chosen


def _texts(array: Column) -> Column:
    """The distinct shingles of an array of words, as texts."""
    n = F.size(array)
    starts = F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1)))
    return F.when(n > 0, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(array, i, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, n_found, n_shingles, containment) of each template found in each text."""
    rows = only(docs, id_col, text_col).toDF("id", "text")
    known = templates.select("text").limit(MOST_TEMPLATES + 1).collect()
    known = [r.text or "" for r in known] if len(known) <= MOST_TEMPLATES else []
    needed = anchors(known)
    if 0 < len(needed) <= MOST_ANCHORS:
        rows = rows.where(reduce(or_, (F.lower("text").contains(a) for a in needed)))
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("words"))
    if len(needed) > MOST_ANCHORS:
        rows = rows.where(F.arrays_overlap("words", F.array(*map(F.lit, anchors(known, inside=False)))))
    rows = _with_flipped(_hashed(rows))
    s, f = F.col("shingles"), F.col("flipped")
    keys = F.concat(*(band for width, (stride, _, bands) in WIDTHS.items() for band in _bands(s, f, width, stride, bands)))
    rows = rows.select("id", "row", "words", F.explode(keys).alias("key"))
    wanted = template_keys(templates)
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    near = rows.join(wanted, "key").groupBy("row", "license").agg(F.first("id").alias("id"), F.first("words").alias("words"))
    sought = templates.select("license", _texts(words(F.col("text"))).alias("sought"))
    found = near.join(F.broadcast(sought) if sought.count() <= MOST_BROADCAST // 100 else sought, "license")
    found = found.select("id", "license", F.size(F.array_intersect("sought", _texts(F.col("words")))).alias("found"), F.size("sought").alias("size"))
    return found.where(F.col("found") >= F.lit(CONTAINED) * F.col("size")).select(
        F.col("id").alias(id_col),
        "license",
        F.col("found").cast("bigint").alias("n_found"),
        F.col("size").cast("bigint").alias("n_shingles"),
        (F.col("found") / F.col("size")).alias("containment"),
    )


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """The same result by comparing all shingles of `documents` with those of the templates."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in (TEMPLATES if templates is None else templates).items())
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    shingle = "array_to_string(w[i:i + 4], ' ')"
    starts = "unnest(range(1, greatest(len(w) - 4, 1) + 1))"
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) v(license, text)),
tw AS (SELECT license, {split} AS w FROM t),
ti AS (SELECT license, w, {starts} AS i FROM tw WHERE len(w) > 0),
ts AS (SELECT DISTINCT license, {shingle} AS s FROM ti),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT doc_id, {split} AS w FROM documents),
di AS (SELECT doc_id, w, {starts} AS i FROM dw WHERE len(w) > 0),
ds AS (SELECT doc_id, {shingle} AS s FROM di),
hit AS (SELECT doc_id, license, count(DISTINCT ds.s) AS found FROM ds JOIN ts ON ds.s = ts.s GROUP BY doc_id, license)
SELECT doc_id, hit.license AS license, CAST(found AS BIGINT) AS n_found, CAST(n AS BIGINT) AS n_shingles,
       CAST(found AS DOUBLE) / n AS containment
FROM hit JOIN tn ON hit.license = tn.license WHERE found >= {CONTAINED} * n
"""
