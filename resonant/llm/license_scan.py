"""Operator 8: licence scan by Dice coefficient over word bigrams. DataFrame functions only.

Each text is normalised (lower case, anything but a-z and 0-9 as a space) and cut
into word bigrams; a template likewise, into its set. Two units are compared with
every template:

* each line on its own;
* each passage of consecutive words, wherever it begins and ends: a notice wrapped
  over several lines, commented, or with other text before or after it. A passage
  begins and ends with a bigram of the template and is no longer than the template
  could be at the coefficient. Of overlapping passages of one template the one of
  greatest coefficient stays; of those of several templates, the one of most
  bigrams in common. A passage within a line that fits on its own, or of a template
  that one of its lines fits on its own, is not reported again.

A set whose number of bigrams lies outside ``[t / (2 - t) * b, (2 - t) / t * b]`` for
a template of b bigrams cannot reach the coefficient t, and what reaches it has
``t / (2 - t) * b`` of them in common, so a text that lacks too many of the
template's words is left after one pass over its words. Templates are constants in
the plan (a fixed, short list, not a table), and nothing is shuffled.

Defined cases: null and empty texts have no lines that match; lines of fewer than
two words have no bigrams and match nothing, nor does such a template; of equal coefficients the template of
least name wins; each line of each row is judged on its own, repeated or not; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and header texts of well-known licences; fixed values, in their published wording.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0/basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause/redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0/warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT/condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT/warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause/source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-3-Clause/binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause/endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause/warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "GPL-2.0/terms": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1/terms": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0/terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Licences whose tag (SPDX-License-Identifier) is a template of its own; fixed values.
TAGS = "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 MIT MPL-2.0 Unlicense".split()
TEMPLATES |= {f"{name}/tag": f"SPDX-License-Identifier: {name}" for name in TAGS}


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(b: int, least: float) -> tuple[int, int]:
    """The numbers of bigrams that can reach the coefficient with a template of b."""
    return math.ceil(least / (2 - least) * b - 1e-9), math.floor((2 - least) / least * b + 1e-9)


def words_needed(grams: list[str], lo: int) -> int:
    """A text of at least ``lo`` of the bigrams has at least so many of their words."""
    degree: dict[str, int] = {}
    for g in grams:
        for w in set(g.split()):
            degree[w] = degree.get(w, 0) + 1
    # a bigram has two words at most, so missing words of n bigrams in all lose n / 2 bigrams or more
    missing, lost = 0, 0
    for n in sorted(degree.values()):
        lost += n
        if lost > 2 * (len(grams) - lo):
            break
        missing += 1
    return len(degree) - missing


def _once(rows: DataFrame, name: str, value) -> DataFrame:
    """``rows`` with a column that is exploded, so that what uses it does not work it out again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _apart(found):
    """Of an array of passages, the first of each that overlap."""
    overlap = lambda a, x: (a["at"] <= x["upto"]) & (x["at"] <= a["upto"])
    return F.aggregate(found, F.slice(found, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda a: overlap(a, x)), kept).otherwise(F.concat(kept, F.array(x))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, line (from 0), license, dice and content of every line and passage that fits a template.

    Of a passage, ``line`` is its first line and ``content`` all lines that it lies in.
    """
    texts = templates or TEMPLATES
    sets = {name: bigrams(text) for name, text in sorted(texts.items())}
    sets = {name: b for name, b in sets.items() if b}
    if not sets:
        return docs.sparkSession.createDataFrame([], "doc_id long, line int, license string, dice double, content string")
    limits = {name: bounds(len(b), least) for name, b in sets.items()}
    strings = lambda x: F.array(*map(F.lit, x))
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")

    # texts that have enough words of some template, and then enough bigrams
    vocabulary = {n: sorted({w for g in b for w in g.split()}) for n, b in sets.items()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _once(rows, "known", F.array_intersect(words("text"), strings(sorted(set().union(*vocabulary.values())))))
    enough = [F.size(F.array_intersect("known", strings(vocabulary[n]))) >= words_needed(b, limits[n][0]) for n, b in sets.items()]
    rows = rows.where(F.size("known") >= min((words_needed(b, limits[n][0]) for n, b in sets.items()), default=0))
    rows = rows.where(F.exists(F.array(*enough), lambda x: x))

    rows = _once(rows, "lines", F.split("text", "\n"))
    rows = _once(rows, "line_words", F.transform("lines", lambda s: F.filter(words(s), lambda w: w != "")))
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.slice(w, 1, 0))
    rows = _once(rows, "grams", pairs(F.flatten("line_words")))

    def template(name: str):
        lo, hi = limits[name]
        raw = len(re.sub(r"[^a-z0-9]+", " ", texts[name].lower()).split()) - 1
        known = F.array_intersect("grams", strings(sets[name]))
        return F.when(F.size(known) >= lo, F.struct(F.lit(name).alias("license"), strings(sets[name]).alias("g"), F.lit(lo).alias("lo"), F.lit(hi + raw - len(sets[name])).alias("most")))

    rows = _once(rows, "possible", F.filter(F.array(*[template(n) for n in sets]), lambda t: t.isNotNull())).where(F.size("possible") > 0)
    rows = _once(rows, "word_line", F.flatten(F.transform("line_words", lambda w, i: F.transform(w, lambda _: i))))

    def score(name: str, g):
        lo, hi = limits[name]
        common = F.size(F.array_intersect(g, strings(sets[name])))
        dice = F.when(F.size(g).between(lo, hi), 2.0 * common / (F.size(g) + F.lit(len(sets[name]))))
        return F.struct((-F.coalesce(dice, F.lit(0.0))).alias("d"), F.lit(name).alias("license"))

    rows = _once(rows, "line_grams", F.transform("line_words", lambda w: F.array_distinct(pairs(w))))
    rows = _once(rows, "fit", F.transform("line_grams", lambda g: F.array_min(F.array(*[score(n, g) for n in sets]))))
    rows = rows.withColumn("fit", F.transform("fit", lambda b: F.when(-b["d"] >= least, b)))

    def passages(t):
        """The passages that fit a template, with the places of their first and last bigram."""
        hits = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda p: F.array_contains(t["g"], F.element_at("grams", p)))
        return F.flatten(F.transform(F.array(hits), lambda h: _of(t, h)))

    def _of(t, h):
        near = lambda k: F.element_at(h, k + t["lo"] - 1) - F.element_at(h, k) < t["most"]
        starts = F.filter(F.sequence(F.lit(1), F.size(h)), lambda k: (k + t["lo"] - 1 <= F.size(h)) & F.when(k + t["lo"] - 1 <= F.size(h), near(k)).otherwise(False))
        found = F.flatten(F.transform(starts, lambda k: _from(t, F.element_at(h, k), F.slice(h, k + t["lo"] - 1, t["most"]))))
        return _apart(F.array_sort(F.filter(found, lambda x: -x["d"] >= least)))

    def _from(t, at, ends):
        fits = F.transform(F.filter(ends, lambda e: e - at < t["most"]), lambda e: _judged(t, at, e, F.slice("grams", at, e - at + 1)))
        return F.array(F.array_min(fits))

    def _judged(t, at, e, g):
        common = F.size(F.array_intersect(g, t["g"]))
        dice = 2.0 * common / (F.size(F.array_distinct(g)) + F.size(t["g"]))
        return F.struct((-dice).alias("d"), (e - at).alias("length"), at.alias("at"), e.alias("upto"), (-common).alias("c"), t["license"].alias("license"))

    rows = _once(rows, "found", F.flatten(F.transform("possible", passages)))
    by_common = F.transform("found", lambda x: F.struct(x["c"].alias("c"), x["d"].alias("d"), x["at"].alias("at"), x["upto"].alias("upto"), x["license"].alias("license")))
    rows = _once(rows, "apart", _apart(F.array_sort(by_common)))
    # the last bigram's second word is one place further than the bigram
    placed = F.transform("apart", lambda x: F.struct(F.element_at("word_line", x["at"]).alias("line"), F.element_at("word_line", x["upto"] + 1).alias("last"), x["license"].alias("license"), (-x["d"]).alias("dice")))
    rows = _once(rows, "placed", placed)
    within = lambda x: F.slice("fit", x["line"] + 1, x["last"] - x["line"] + 1)
    told = lambda x: F.exists(within(x), lambda f: f.isNotNull() & ((x["line"] == x["last"]) | F.coalesce(f["license"] == x["license"], F.lit(False))))
    alone = F.filter(F.transform("fit", lambda f, i: F.when(f.isNotNull(), F.struct(i.alias("line"), i.alias("last"), f["license"].alias("license"), (-f["d"]).alias("dice")))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "lines", F.explode(F.concat(alone, F.filter("placed", lambda x: ~told(x)))).alias("x"))
    content = F.array_join(F.slice("lines", F.col("x.line") + 1, F.col("x.last") - F.col("x.line") + 1), "\n")
    return rows.select("doc_id", "x.line", "x.license", "x.dice", content.alias("content"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in TEMPLATES.items())
    cut = lambda c: f"[x FOR x IN string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ') IF x <> '']"
    pairs = "[w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]"
    # of passages in order, the first of each that overlap
    apart = "list_reduce([[x] FOR x IN ps], lambda kept, x: CASE WHEN len([k FOR k IN kept IF k.start <= x[1].upto AND x[1].start <= k.upto]) > 0 THEN kept ELSE list_concat(kept, x) END)"
    return f"""
WITH t AS MATERIALIZED (
  SELECT license, g, len(g) AS b, CAST(ceil(0.8 / 1.2 * len(g) - 1e-9) AS BIGINT) AS lo, CAST(floor(1.2 / 0.8 * len(g) + 1e-9) AS BIGINT) + len(w) - 1 - len(g) AS most
  FROM (SELECT license, w, list_distinct({pairs}) AS g FROM (SELECT license, {cut('body')} AS w FROM (VALUES {rows}) v(license, body)))),
docs AS MATERIALIZED (
  SELECT r, doc_id, p, lw, w, {pairs} AS grams FROM (
    SELECT r, doc_id, p, lw, flatten(lw) AS w FROM (
      SELECT r, doc_id, p, [{cut('s')} FOR s IN p] AS lw FROM (
        SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)))),
lines AS (SELECT r, line, list_distinct({pairs}) AS g FROM (SELECT r, unnest(range(len(lw))) AS line, unnest(lw) AS w FROM docs) WHERE len(w) > 1),
scored AS (SELECT r, line, license, 2.0::DOUBLE * len(list_intersect(lines.g, t.g)) / (len(lines.g) + t.b) AS dice FROM lines, t),
fit AS MATERIALIZED (SELECT r, line, min_by(license, struct_pack(d := -dice, l := license)) AS license, max(dice) AS dice FROM scored WHERE dice >= 0.8 GROUP BY r, line),
known AS (SELECT license, lo, most, unnest(g) AS gram FROM t),
places AS (SELECT r, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS start FROM docs),
met AS MATERIALIZED (SELECT r, license, lo, most, start, gram FROM places JOIN known USING (gram)),
possible AS (SELECT r, license FROM met GROUP BY r, license, lo HAVING count(DISTINCT gram) >= lo),
hits AS MATERIALIZED (SELECT r, license, lo, most, start, row_number() OVER (PARTITION BY r, license ORDER BY start) AS k FROM met SEMI JOIN possible USING (r, license)),
spans AS (SELECT a.r, a.license, a.start, z.start AS upto FROM hits a JOIN hits z ON a.r = z.r AND a.license = z.license AND z.k >= a.k + a.lo - 1 AND z.start - a.start < a.most),
cut AS (
  SELECT r, license, start, upto, b, len(g) AS n, len(list_intersect(g, tg)) AS common FROM (
    SELECT s.r, s.license, s.start, s.upto, t.b, t.g AS tg, list_distinct(d.grams[s.start:s.upto]) AS g FROM spans s JOIN docs d ON s.r = d.r JOIN t ON s.license = t.license)),
best AS (
  SELECT r, license, min(struct_pack(d := -(2.0::DOUBLE * common / (n + b)), length := upto - start, start := start, upto := upto, c := -common)) AS x FROM cut GROUP BY r, license, start),
found AS (SELECT r, license, unnest({apart}) AS x FROM (SELECT r, license, list(x ORDER BY x) AS ps FROM best WHERE -x.d >= 0.8 GROUP BY r, license)),
chosen AS (
  SELECT r, unnest({apart}) AS x FROM (
    SELECT r, list(y ORDER BY y) AS ps FROM (SELECT r, struct_pack(c := x.c, d := x.d, start := x.start, upto := x.upto, license := license) AS y FROM found) GROUP BY r)),
placed AS (
  SELECT r, l[x.start] AS line, l[x.upto + 1] AS last, x.license AS license, -x.d AS dice
  FROM chosen JOIN (SELECT r, flatten([[i FOR x IN lw[i + 1]] FOR i IN range(len(lw))]) AS l FROM docs) USING (r)),
told AS (
  SELECT r, line, line AS last, license, dice FROM fit
  UNION ALL
  SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM fit f WHERE f.r = p.r AND f.line BETWEEN p.line AND p.last AND (p.line = p.last OR f.license = p.license)))
SELECT doc_id, CAST(line AS INTEGER) AS line, license, round(dice, 6) AS dice, array_to_string(p[line + 1:last + 1], chr(10)) AS content FROM told JOIN docs USING (r)
"""


ORACLE = _oracle()
