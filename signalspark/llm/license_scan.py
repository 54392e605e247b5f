"""License scans with a positional index of rare words.

A word's weight is its inverse document frequency over all scanned documents. The index holds, for each notice of a
fixed list, the places of its heaviest words, so what a file has of them are its rarest licence words. They are looked
up there; what stands in the file at position i and in a notice at position p votes for the offset i - p. Offsets may
drift by some words within a notice, so votes are gathered in overlapping bands of offsets, each place of the notice
once. Where a band gathers most of a notice's weight, the file is a candidate for it, and it is verified by the
notice's mandatory phrases. Plain phrases are looked for besides.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))


# Phrases of the plain scan; notices with their mandatory phrases; words too common to index.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEXTS = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache license version 2 0", "in compliance with the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "redistribute it and or modify")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("free of charge", "without restriction", "the above copyright notice and this permission notice")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ("for any purpose with or without fee", "this permission notice appear in all copies")),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("to endorse or promote products derived from this software",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.", ("the origin of this software must not be misrepresented", "must be plainly marked as such")),
    ("boost-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", ("any person or organization obtaining a copy of the software and accompanying documentation",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software released into the public domain", "either in source code form or as a compiled binary")),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("required by applicable law or agreed to in writing", "governing permissions and limitations under the license")),
)
# Identifiers of the SPDX list, and names of licences under which they are told.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "MPL-2.0", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CDDL-1.0", "Artistic-2.0", "WTFPL", "OFL-1.1", "PostgreSQL", "NCSA", "Python-2.0", "PHP-3.01", "Ruby", "Vim", "X11", "MS-PL", "MS-RL", "OSL-3.0", "AFL-3.0", "ECL-2.0", "UPL-1.0",
    "MulanPSL-2.0", "CECILL-2.1", "Beerware", "Libpng", "OpenSSL", "curl",
)
NAMES = (
    ("lgpl-3.0", "GNU Lesser General Public License version 3"), ("lgpl-2.1", "GNU Lesser General Public License version 2.1"), ("agpl-3.0", "GNU Affero General Public License version 3"), ("gpl-2.0", "GNU General Public License version 2"),
    ("cc0-1.0", "CC0 1.0 Universal"), ("cc0-1.0", "Creative Commons Zero"), ("epl-2.0", "Eclipse Public License v 2.0"), ("epl-1.0", "Eclipse Public License v 1.0"), ("eupl-1.2", "European Union Public Licence"),
    ("cddl-1.0", "Common Development and Distribution License"), ("artistic-2.0", "Artistic License 2.0"), ("wtfpl", "Do What The Fuck You Want To Public License"), ("ofl-1.1", "SIL Open Font License"), ("ncsa", "University of Illinois NCSA Open Source License"),
    ("python-2.0", "Python Software Foundation License"), ("php-3.01", "PHP License version 3.01"), ("ms-pl", "Microsoft Public License"), ("ms-rl", "Microsoft Reciprocal License"), ("osl-3.0", "Open Software License version 3.0"),
    ("afl-3.0", "Academic Free License version 3.0"), ("ecl-2.0", "Educational Community License version 2.0"), ("upl-1.0", "Universal Permissive License"), ("mulanpsl-2.0", "Mulan Permissive Software License"), ("boost-1.0", "Boost Software License version 1.0"),
    ("postgresql", "PostgreSQL License"), ("beerware", "THE BEER-WARE LICENSE"), ("bsd-3-clause", "BSD 3-Clause License"), ("bsd-2-clause", "BSD 2-Clause License"), ("mpl-2.0", "Mozilla Public License version 2.0"),
)


def named() -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """Notices that are a name, or a line with an identifier: alone or first in an expression, or behind its first OR or AND."""
    out = [(label, name, (" ".join(words_of(name)),)) for label, name in NAMES]
    for identifier in SPDX:
        label, own = {"BSL-1.0": "boost-1.0"}.get(identifier, identifier.lower()), " ".join(words_of(identifier))
        out.append((label, f"SPDX-License-Identifier: {identifier}", (f"spdx license identifier {own}",)))
        # three common words, which aren't indexed, stand for the first operand
        out += [(label, f"SPDX-License-Identifier: (this or that) {word} {identifier}", ("spdx license identifier", f"{word} {own}")) for word in ("or", "and")]
    return tuple(out)


#: Words of a notice that are indexed, heaviest first; words by which offsets may drift within a notice at least, and as a share of it.
INDEXED, LEAST_DRIFT, DRIFT = 12, 2, 0.25
COMMON = frozenset("the of and in to a is this that it as or for by with at be are an any all on not from you may can under into above these such no if will".split())

#: All notices: whole texts and headers first, then names and identifiers.
NOTICES = TEXTS + named()



def postings() -> list[tuple[str, int, int]]:
    """(word, notice, position) of all words that can be indexed."""
    return [(w, n, p) for n, (_, text, _) in enumerate(NOTICES) for p, w in enumerate(words_of(text)) if w not in COMMON]


def vocabulary() -> list[str]:
    return sorted({w for w, _, _ in postings()} | {w for phrase, _ in PHRASES for w in phrase.split()})


def rare_index(idf: dict[str, float], most: float) -> list[tuple[str, int, int, float]]:
    """(word, notice, position, share of the notice's weight) of the heaviest words of each notice, all their places."""
    out: list[tuple[str, int, int, float]] = []
    by_notice: dict[int, list[tuple[str, int]]] = {}
    for w, n, p in postings():
        by_notice.setdefault(n, []).append((w, p))
    for n, found in by_notice.items():
        chosen = set(sorted({w for w, _ in found}, key=lambda w: (-idf.get(w, most), w))[:INDEXED])
        held = [(w, p, idf.get(w, most)) for w, p in found if w in chosen]
        whole = sum(weight for *_, weight in held)
        out += [(w, n, p, weight / whole) for w, p, weight in held]
    return out


def drift(notice: int) -> int:
    return max(LEAST_DRIFT, int(len(words_of(NOTICES[notice][1])) * DRIFT))


def plain_places() -> Column:
    """(start, label) of every place of a phrase, found in the ``hits`` (i, w), which hold all words of phrases."""
    hit = lambda j: F.get(F.col("hits"), j)

    def stands(phrase: str, j: Column) -> Column:
        tests = [(hit(j + k)["w"] == w) & (hit(j + k)["i"] == hit(j)["i"] + k) for k, w in enumerate(phrase.split())]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    def labels(j: Column) -> Column:
        return F.array_compact(F.array(*[F.when(stands(phrase, j), F.struct(hit(j)["i"].alias("start"), F.lit(label).alias("label"))) for phrase, label in PHRASES]))

    none = F.array().cast("array<struct<start:int,label:string>>")
    return F.when(F.size("hits") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - 1), labels))).otherwise(none)


def read_words(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A narrow row per input row: its words' number, the words of the vocabulary with their positions, the
    places of the plain phrases and the mandatory phrases it has."""
    vocab = vocabulary()
    text = lower_ascii(F.coalesce(F.col(text_column), F.lit("")))
    words = df.select(F.col(id_column).cast("long").alias("id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    at = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), i).isin(vocab)))
    placed = words.withColumn("at", F.coalesce(at, F.array().cast("array<int>")))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    mandatory = sorted({p for _, _, phrases in NOTICES for p in phrases})
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("joined"), F.lit(f" {p} ")), F.lit(p)) for p in mandatory]))
    found = placed.select("id", F.size("words").cast("long").alias("n_words"), F.transform("at", lambda i: F.struct(i.alias("i"), F.get(F.col("words"), i).alias("w"))).alias("hits"), F.when(F.size("at") > 1, joined).alias("joined"))
    found = found.select("id", "n_words", "hits", F.when(F.col("joined").isNotNull(), has).alias("phrases"))
    return found.withColumn("row", F.monotonically_increasing_id()).withColumn("places", plain_places())


def weights(scanned: DataFrame) -> dict[str, float]:
    """Inverse document frequency, over all rows, of each word of the vocabulary; the driver gets no more rows
    than the vocabulary has words."""
    total = scanned.count()
    df = scanned.where(F.size("hits") > 0).select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count()
    return {r["w"]: math.log1p(total / r["count"]) for r in df.collect()}


def found_notices(scanned: DataFrame, share: float) -> DataFrame:
    """(row, found, share): the labels of the notices that were found and verified in a row, and the largest share."""
    spark = scanned.sparkSession
    idf = weights(scanned)
    rows = [(w, n, p, part, drift(n)) for w, n, p, part in rare_index(idf, math.log1p(scanned.count()) if idf else 1.0)]
    index = spark.createDataFrame(rows, "w string, notice int, p int, part double, drift int")
    notices = spark.createDataFrame([(n, label, list(needs)) for n, (label, _, needs) in enumerate(NOTICES)], "notice int, label string, needs array<string>")
    rare = sorted({w for w, *_ in rows})
    hits = scanned.select("row", F.explode(F.filter("hits", lambda h: h["w"].isin(rare))).alias("h")).select("row", "h.i", "h.w")
    votes = hits.join(F.broadcast(index), "w")  # a fixed list: some hundred rows
    bands = [F.struct(F.lit(k).alias("shift"), F.floor((F.col("i") - F.col("p") + k * F.col("drift")) / (2 * F.col("drift"))).alias("at")) for k in (0, 1)]
    placed = votes.select("row", "notice", "p", "part", F.explode(F.array(*bands)).alias("band")).distinct()
    near = placed.groupBy("row", "notice", "band").agg(F.sum("part").alias("share")).where(F.col("share") >= share - 1e-9).groupBy("row", "notice").agg(F.max("share").alias("share"))
    candidates = near.join(F.broadcast(notices), "notice").join(scanned.select("row", "phrases"), "row")
    verified = candidates.where(F.size(F.array_except("needs", F.coalesce("phrases", F.array().cast("array<string>")))) == 0)
    return verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = 0.6) -> DataFrame:
    """One row per input row: the id; ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels``
    for the plain phrases (all places, smallest and largest start in words from 0); ``labels``, these and those
    of the notices found; ``score``, the largest share of a notice's indexed weight that a band of offsets gathers, at
    least 0.5 where a plain phrase stands, else 0, rounded to 6 places.

    A null or empty text has no words (0, 0, null, null, empty labels, score 0). A text of any length is read
    whole. Repeated rows and equal ids are scanned on their own; an empty table gives an empty result; other
    columns are not read. Texts are read once and are not shuffled; only hits in the rare-word index are, by row.
    """
    scanned = written(read_words(df, id_column, text_column), "license-words")
    notices = found_notices(scanned, share)
    none = F.lit(None).cast("array<string>"), F.lit(None).cast("double")
    no_phrase = F.coalesce(F.size("phrases"), F.lit(-1)) <= 0  # nothing can be verified there
    near = scanned.where(~no_phrase).join(notices, "row", "left")
    rest = scanned.where(no_phrase).select(*scanned.columns, none[0].alias("found"), none[1].alias("share"))
    both = near.select(*rest.columns).union(rest)
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    return both.select(
        F.col("id").alias(id_column),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.least(F.lit(1.0), F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))), 6).alias("score"),
    )


def duckdb_sql(share: float = 0.6) -> str:
    """What :func:`scan` gives for the table ``documents``, in DuckDB's SQL."""
    quoted = lambda *x: "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in x) + ")"
    index = ", ".join(quoted(w, n, NOTICES[n][0], p, drift(n)) for w, n, p in postings())
    needs = ", ".join(quoted(n, f" {phrase} ") for n, (_, _, phrases) in enumerate(NOTICES) for phrase in phrases)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{WORD}') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d),
x AS (SELECT *, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
places AS (SELECT r, i, CASE WHEN w = 'general' THEN 'gpl' ELSE w END AS label FROM x
  WHERE (w IN ('mit', 'apache') AND w1 = 'license') OR (w = 'general' AND w1 = 'public' AND w2 = 'license')),
base AS (SELECT r, count(*) AS n, min(i) AS low, max(i) AS high, list(DISTINCT label) AS labels FROM places GROUP BY r),
postings(w, notice, label, p, drift) AS (VALUES {index}),
needs(notice, phrase) AS (VALUES {needs}),
df AS (SELECT w, count(DISTINCT r) AS n FROM t WHERE w IN (SELECT w FROM postings) GROUP BY w),
weighed AS (SELECT p.*, ln(1 + (SELECT count(*) FROM d) / coalesce(df.n, 1)) AS weight FROM postings p LEFT JOIN df ON p.w = df.w),
rare AS (SELECT * FROM weighed QUALIFY dense_rank() OVER (PARTITION BY notice ORDER BY weight DESC, w) <= {INDEXED}),
whole AS (SELECT notice, sum(weight) AS weight FROM rare GROUP BY notice),
placed AS (SELECT DISTINCT t.r, v.notice, v.label, v.p, v.weight, k AS shift, floor((t.i - v.p + k * v.drift) / (2 * v.drift)) AS band
  FROM t JOIN rare v ON t.w = v.w, (VALUES (0), (1)) ks(k)),
votes AS (SELECT r, placed.notice, label, shift, band, sum(placed.weight) / any_value(whole.weight) AS share
  FROM placed JOIN whole ON whole.notice = placed.notice GROUP BY ALL HAVING share >= {share} - 1e-9),
found AS (SELECT v.r, list(DISTINCT v.label) AS labels, max(v.share) AS share FROM votes v JOIN d ON d.r = v.r
  WHERE NOT EXISTS (SELECT 1 FROM needs WHERE needs.notice = v.notice AND NOT contains(' ' || array_to_string(d.w, ' ') || ' ', needs.phrase)) GROUP BY v.r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(base.n, 0) AS n_base, base.low AS first_word, base.high AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  round(least(1.0, greatest(coalesce(found.share, 0), CASE WHEN base.n > 0 THEN 0.5 ELSE 0 END)), 6) AS score
FROM d LEFT JOIN base ON d.r = base.r LEFT JOIN found ON d.r = found.r
"""
