"""License scan: phrases and an exact set-similarity join with license notices and texts.

A block of a text is a window of words: for a template of n words the windows begin at every
n-th word and are 2n words long, over line ends, so a notice of up to n + 1 words lies whole
in one of them, and blocks are as long as their template asks for. A block matches a template
that has at least 80 % of its distinct words in the block. The join is exact: tokens are
ordered by how many texts hold them, rarest first; a block that matches holds one of the
template's first ``size - need + 1`` tokens (prefix filter), has ``need`` words that templates
know (length filter), and the places of a shared token in both orders leave room for ``need``
shared ones (positional filter). What passes is verified on the whole sets.

A text is taken apart once: a written table holds its words in their order, those that no
template has as nulls, and numbers and places of the phrases. Counts of tokens and blocks come
from that table. DataFrame expressions only.

Edge cases: a null text is empty; a text without words has 0 words, no label and score 0;
rows without ``doc_id``, repeated rows and texts of any length are rows like others, kept
apart by a row number of the written scan; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.storage import kept

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Usual notices and whole short licenses by label, public texts. Their words alone bound what is broadcast.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]
NUM, DEN = 80, 100
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: int
    tokens: tuple[str, ...]

    @property
    def need(self) -> int:
        return -(-NUM * len(self.tokens) // DEN)


def template_sets(templates: list[tuple[str, str]]) -> list[Template]:
    split = [(label, re.findall(WORD, text.lower())) for label, text in templates]
    return [Template(label, len(words), tuple(dict.fromkeys(words))) for label, words in split]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def bound_once(value: Column, use) -> Column:
    """use(value), with the value computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def starts(all_words: Column, phrase: str) -> Column:
    """Places, from 0, where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        ok = F.get(all_words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            ok = ok & (F.get(all_words, i + j) == part)
        return ok

    return F.filter(F.sequence(F.lit(0), F.size(all_words)), here)


def places(all_words: Column) -> Column:
    """One array of starts for each phrase; texts without a phrase's last word are not searched."""
    last = strings(sorted({phrase.split()[-1] for phrase in PHRASES}))
    none = F.array(*[F.array().cast("array<int>") for _ in PHRASES])
    return F.when(F.arrays_overlap(all_words, last), F.array(*[starts(all_words, p) for p in PHRASES])).otherwise(none)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def taken_apart(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row, doc_id, n_words, places of the phrases, and the words in their order, null where no template has them."""

    def parts(w: Column) -> Column:
        tokens = F.transform(w, lambda x: F.when(x.isin(vocabulary), x))
        return F.struct(F.size(w).cast("long").alias("n_words"), places(w).alias("places"), tokens.alias("tokens"))

    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", bound_once(words(F.col("lower")), parts).alias("of")).select("row", "doc_id", "of.*")


def token_order(scanned: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by the number of texts that hold them, over all rows, rarest first."""
    held = scanned.select(F.explode(F.array_compact(F.array_distinct("tokens"))).alias("token"))
    counts = {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row for each template token at most
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def windows(tokens: Column, of: int, template: Template, prefix: list[str]) -> Column:
    """The windows for a template that hold a token of its prefix, as struct(template, words); words are those that templates have."""
    n = template.words
    first = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tokens) / n).cast("int") - 1, F.lit(0)))
    cut = F.transform(first, lambda j: F.slice(tokens, j * n + 1, F.lit(2 * n)))
    near = F.filter(cut, lambda w: F.arrays_overlap(w, strings(prefix)))
    found = F.transform(near, lambda w: F.struct(F.lit(of).alias("template"), F.array_compact(F.array_distinct(w)).alias("words")))
    return F.when(F.arrays_overlap(tokens, strings(prefix)), found).otherwise(F.array().cast(BLOCKS))


BLOCKS = "array<struct<template:int,words:array<string>>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    spark = docs.sparkSession
    sets = template_sets(templates)
    vocabulary = sorted({t for s in sets for t in s.tokens})
    rows = docs.select(F.col(key).alias("doc_id"), lowered(F.col(text)).alias("lower"))
    scanned = kept(taken_apart(rows, vocabulary), "license-scan")
    order = token_order(scanned, vocabulary)
    rank = {t: i for i, t in enumerate(order)}
    index, first = [], []
    for i, s in enumerate(sets):
        tokens = sorted(s.tokens, key=rank.get)
        first.append(tokens[: len(tokens) - s.need + 1])
        index += [(i, token, at, len(tokens), s.need, s.label, tokens) for at, token in enumerate(first[i])]
    some = sorted({t for own in first for t in own})

    prefixes = F.broadcast(spark.createDataFrame(index, "template int, token string, at int, size int, need int, label string, tokens array<string>"))
    blocks = F.flatten(F.array(*[windows(F.col("tokens"), i, s, first[i]) for i, s in enumerate(sets)]))
    block = scanned.filter(F.arrays_overlap("tokens", strings(some))).select("row", F.inline(blocks))
    block = block.withColumn("ordered", F.array_intersect(strings(order), "words"))
    shared = block.select("row", "template", "words", F.size("ordered").alias("n"), F.posexplode("ordered").alias("place", "token")).join(prefixes, ["template", "token"])
    room = F.least("place", "at") + F.least(F.col("n") - F.col("place"), F.col("size") - F.col("at"))
    shared = shared.filter((F.size("words") >= F.col("need")) & (room >= F.col("need")))
    shared = shared.withColumn("both", F.size(F.array_intersect("words", "tokens"))).filter("both >= need")
    found = shared.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("both") / F.col("size")).alias("best"))

    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))))
    every = F.flatten("places")
    out = scanned.join(found, "row", "left").withColumn("base", base).withColumn("every", every)
    return out.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same rows in DuckDB SQL, comparing every window of every template with it."""
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    rows = ", ".join(f"('{s.label}', {s.words}, {quoted(s.tokens)}, {s.need})" for s in template_sets(templates))
    hits = []
    for phrase, label in PHRASES.items():
        cond = " AND ".join(f"w[i + {j}] = '{part}'" for j, part in enumerate(phrase.split(), 1))
        hits.append(f"list_filter(range(len(w)), lambda i: {cond}) AS {label}_at")
    at = [f"{label}_at" for label in PHRASES.values()]
    every = f"flatten([{', '.join(at)}])"
    base = f"list_sort(list_filter([{', '.join(f'CASE WHEN len({a}) > 0 THEN {chr(39)}{a[:-3]}{chr(39)} END' for a in at)}], lambda x: x IS NOT NULL))"
    return f"""
WITH t(label, n, tokens, need) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT rid, doc_id, low, regexp_extract_all(low, '{WORD}') AS w FROM d),
p AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, {', '.join(hits)} FROM w),
q AS (SELECT rid, doc_id, n_words, {every} AS hit, {base} AS base FROM p),
b AS (SELECT rid, label, tokens, need, w[i * n + 1 : i * n + 2 * n] AS ws FROM (SELECT rid, w, label, n, tokens, need, unnest(range(greatest(1, (len(w) + n - 1) // n))) AS i FROM w, t)),
m AS (SELECT rid, label, len(list_intersect(list_distinct(ws), tokens)) AS n_shared, len(tokens) AS size, need FROM b),
f AS (SELECT rid, list(DISTINCT label) AS found, max(n_shared::DOUBLE / size::DOUBLE) AS best FROM m WHERE n_shared >= need GROUP BY rid)
SELECT doc_id, n_words, len(hit)::BIGINT AS n_base, list_min(hit)::BIGINT AS first_word, list_max(hit)::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(hit) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN f USING (rid)
"""
