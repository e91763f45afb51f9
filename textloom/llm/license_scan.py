r"""Licence scan: text units compared to licence templates by the Dice coefficient of their word bigrams.

A unit is a line of a text, a paragraph of several lines, or the whole text. Units and templates are normalised alike: A-Z lower-cased, every run of other
characters than a-z and 0-9 a blank. With a threshold t, two bigram sets of sizes a and b can only reach it if
a >= b * t / (2 - t) and a <= b * (2 - t) / t: units outside every template's bounds never get bigrams, and a unit is only
compared with the templates whose bounds it meets.

``scan`` takes these units, as the registered query's SQL does; ``notices`` takes word windows of the whole text and so finds
notices in the midst of other words too.

All of it is built-in column functions. The templates are literals: their number bounds what reaches the tasks.

Cases: null text counts as empty; units of fewer than two words match nothing; of templates that match a unit equally well the first in the list is
named; a text of one line is that line only; repeated rows give repeated rows; rows without id are scanned; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import work

#: Least Dice coefficient, in percent: sizes are compared as whole numbers.
PERCENT = 80

#: Short notices and permission texts of public licences, (SPDX identifier, template).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
]
# The paragraphs of whole licence texts, by their places above, with the clauses that stand between them.
_PART = lambda start: next(t for _, t in TEMPLATES if t.startswith(start))
_BSD2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES += [
    ("MIT", " ".join(map(_PART, ("Permission is hereby granted, free", "The above copyright notice", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT')))),
    ("ISC", " ".join(map(_PART, ("Permission to use, copy, modify, and/or", 'THE SOFTWARE IS PROVIDED "AS IS" AND')))),
    ("BSD-2-Clause", f"{_PART('Redistribution and use')} {_BSD2} {_PART('THIS SOFTWARE IS PROVIDED BY')}"),
    ("BSD-3-Clause", f"{_PART('Redistribution and use')} {_BSD2} 3. {_PART('Neither the name')} {_PART('THIS SOFTWARE IS PROVIDED BY')}"),
    ("Zlib", _PART("This software is provided 'as-is'") + " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", f"{_PART('Licensed under the Apache License, Version 2.0 (the')} {_PART('Unless required by')}"),
]
#: What parts paragraphs.
BLANK_LINES = r"\n[ \t\r]*\n[ \t\r\n]*"
#: Licences that restrict what a derived work may be used for or must be shared under.
RESTRICTED = ["AGPL-3.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL", "GPL-2.0", "GPL-3.0", "LGPL-3.0"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip(" ").split(" ")


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})  # noqa: B905, RUF007


def bounds(size: int, percent: int) -> tuple[int, int]:
    """The sizes that a set may have to reach the threshold with one of ``size``."""
    return -(-size * percent // (200 - percent)), size * (200 - percent) // percent


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(lower: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, templates=None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit that matches: doc_id, unit (0: the whole text, n: line n, -n: paragraph n, of several lines), license, template (its place in the list), dice, restricted."""
    table = [(i, name, bigrams_of(t)) for i, (name, t) in enumerate(TEMPLATES if templates is None else templates)]
    table = [x for x in table if x[2]]
    lows, highs = zip(*(bounds(len(b), percent) for _, _, b in table), strict=True)
    known = sorted({g for _, _, b in table for g in b})
    needs = [-(-percent * (low + len(b)) // 200) for (_, _, b), low in zip(table, lows, strict=True)]  # the least that a match has in common with its template
    held = lambda c: F.explode(F.array(c))  # noqa: E731  a projection that later filters do not repeat
    found = work.spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), work.text_of(text_col).alias("text")))
    found = found.select("doc_id", held(F.struct(F.split("text", "\n", -1).alias("lines"), F.split("text", BLANK_LINES, -1).alias("parts"))).alias("cut"), "text")  # split once, not for each paragraph
    parts = F.when(F.size("cut.parts") > 1, F.col("cut.parts")).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.size("cut.lines") > 1, F.col("text")).otherwise(F.lit(""))
    several = F.transform(parts, lambda p: F.when(F.contains(F.btrim(p, F.lit(" \t\r\n")), F.lit("\n")), p).otherwise(F.lit("")))
    found = found.select("doc_id", F.size("cut.lines").alias("n"), F.concat(F.array(whole), F.col("cut.lines"), several).alias("units"))
    found = found.select("doc_id", "n", F.posexplode("units").alias("at", "line"))  # beside the generator stands no more than its rows need
    found = found.where(F.length("line") >= 2 * min(lows))  # n words take 2n - 1 characters at least
    found = found.select("doc_id", F.when(F.col("at") <= F.col("n"), F.col("at")).otherwise(F.col("n") - F.col("at")).alias("unit"), "line")
    found = found.select("doc_id", "unit", held(_words(_lower(F.col("line")))).alias("words")).where(F.size("words") > min(lows))
    found = found.select("doc_id", "unit", held(_bigrams(F.col("words"))).alias("grams")).where(F.size("grams").between(min(lows), max(highs)))
    found = found.select("doc_id", "unit", F.size("grams").alias("n"), held(F.filter("grams", lambda g: g.isin(known))).alias("hits")).where(F.size("hits") >= min(needs))

    def dice(low: float, high: float, own: list[str]) -> Column:
        both = F.size(F.array_intersect(F.col("hits"), F.array(*(F.lit(x) for x in own))))
        return F.when(F.col("n").between(low, high), 2 * both / (F.col("n") + len(own))).otherwise(F.lit(0.0))

    scores = [F.struct(dice(lo, hi, b).alias("dice"), F.lit(-i).alias("place"), F.lit(name).alias("license")) for (i, name, b), lo, hi in zip(table, lows, highs, strict=True)]
    found = found.select("doc_id", "unit", held(F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("best")).where(F.col("best.dice") * 100 >= percent)
    return found.select("doc_id", F.col("unit").cast("long").alias("unit"), F.col("best.license").alias("license"), (-F.col("best.place")).cast("long").alias("template"), F.round("best.dice", 6).alias("dice"), F.col("best.license").isin(RESTRICTED).alias("restricted"))


def notices(docs: DataFrame, templates=None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each template that some words of a text match, line breaks or not: doc_id, word and words (the best window's first word and length), license, template, dice, restricted.

    Windows have as many bigrams as the template's upper bound at most. The best one begins and ends with a bigram of the template, so only those are compared.
    Of matches that overlap, the better one stays, of equally good ones the longer.
    """
    table = [(i, name, bigrams_of(t)) for i, (name, t) in enumerate(TEMPLATES if templates is None else templates)]
    table = [(i, name, own, *bounds(len(own), percent)) for i, name, own in table if own]
    known = sorted({g for _, _, own, _, _ in table for g in own})
    held = lambda c: F.explode(F.array(c))  # noqa: E731  a projection that later filters do not repeat
    every = F.array(*(F.struct(F.lit(-i).alias("place"), F.lit(name).alias("license"), F.array(*map(F.lit, own)).alias("own"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for i, name, own, lo, hi in table))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), held(_words(_lower(F.coalesce(F.col(text_col), F.lit(""))))).alias("words"))
    pairs = F.transform(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat(F.get("words", i), F.lit(" "), w))
    found = found.select("doc_id", held(pairs).alias("pairs"))
    found = found.select("doc_id", "pairs", held(F.filter(F.transform("pairs", lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: x["g"].isin(known))).alias("hits"))
    found = found.where(F.size("hits") >= min(lo for *_, lo, _ in table))

    def windows(t: Column, hits: Column) -> Column:
        ends = lambda x, k: F.filter(F.slice(hits, k + t["low"], t["high"]), lambda y: y["i"] - x["i"] < t["high"])  # noqa: E731  a match has low hits at least
        spans = F.flatten(F.transform(hits, lambda x, k: F.transform(ends(x, k), lambda y: F.struct(x["i"].alias("a"), (y["i"] - x["i"] + 1).alias("n")))))

        def scored(w: Column) -> Column:
            own = F.slice("pairs", w["a"] + 1, w["n"])
            dice = 2 * F.size(F.array_intersect(own, t["own"])) / (F.size(F.array_distinct(own)) + F.size(t["own"]))
            return F.struct(dice.alias("dice"), w["n"].alias("n"), t["place"].alias("place"), (-w["a"]).alias("at"), t["license"].alias("license"))

        return F.array_max(F.transform(spans, scored))

    best = F.transform(every, lambda t: windows(t, F.filter("hits", lambda x: F.array_contains(t["own"], x["g"]))))
    found = found.select("doc_id", held(F.filter(best, lambda m: m["dice"] * 100 >= percent)).alias("best"))
    beaten = lambda m: F.exists("best", lambda o: (o > m) & (-o["at"] <= m["n"] - m["at"]) & (-m["at"] <= o["n"] - o["at"]))
    found = found.select("doc_id", F.explode(F.filter("best", lambda m: ~beaten(m))).alias("m"))
    return found.select("doc_id", (-F.col("m.at")).cast("long").alias("word"), (F.col("m.n") + 1).cast("long").alias("words"), "m.license", (-F.col("m.place")).cast("long").alias("template"), F.round("m.dice", 6).alias("dice"), F.col("m.license").isin(RESTRICTED).alias("restricted"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = ",\n  ".join(f"({i}, '{name}', '{' '.join(words_of(t))}')" for i, (name, t) in enumerate(TEMPLATES))
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    norm = f"string_split(trim(regexp_replace(translate({{0}}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')"
    return f"""
WITH templates(place, license, words) AS (VALUES
  {rows}
), t AS (
  SELECT place, license, {grams.format("string_split(words, ' ')")} AS grams FROM templates
), u AS (
  SELECT doc_id, unnest(list_concat(range(0, len(s) + 1), list_transform(range(1, len(p) + 1), lambda i: -i))) AS unit,
         unnest(list_concat(list_concat([CASE WHEN len(s) > 1 THEN text ELSE '' END], s), list_transform(p, lambda x: CASE WHEN len(p) > 1 AND contains(trim(x, chr(32) || chr(9) || chr(13) || chr(10)), chr(10)) THEN x ELSE '' END))) AS line
  FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS s, string_split_regex(coalesce(text, ''), '{BLANK_LINES}') AS p FROM documents)
), w AS (
  SELECT doc_id, unit, {norm.format("line")} AS words FROM u
), g AS (
  SELECT doc_id, unit, {grams.format("words")} AS grams FROM w WHERE len(words) > 1
), d AS (
  SELECT doc_id, unit, place, license, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON len(g.grams) * {200 - PERCENT} >= len(t.grams) * {PERCENT} AND len(g.grams) * {PERCENT} <= len(t.grams) * {200 - PERCENT}
)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, license, CAST(place AS BIGINT) AS template, round(dice, 6) AS dice,
       license IN ({", ".join(f"'{x}'" for x in RESTRICTED)}) AS restricted
FROM d WHERE dice * 100 >= {PERCENT}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, place) = 1
"""


ORACLE = _oracle()
