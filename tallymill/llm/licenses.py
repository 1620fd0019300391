"""Licence scans: Dice coefficient over word bigrams between texts and licence templates.

The units compared are each line of a document, each run of consecutive lines, and the document as a whole. A
unit is put in lower case, everything but letters and digits becomes one space, and its different word bigrams
are counted. With a threshold t, a template of m bigrams can only match units of t m / (2 - t) to m (2 - t) / t
bigrams, so it shares at least t (m + t m / (2 - t)) / 2 with any unit that matches. A document without that many
of them holds no such unit: one look at its bigrams settles most documents, and only the others are cut into units.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import id_key, stored

THRESHOLD = "0.8"

# The wording of public licences and of the notices by which works name them.
TEXTS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                   "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
                   "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."],
    "BSD-2-Clause": ["This work is licensed under the BSD 2-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
                     "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS "
                     "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
                     "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
                     "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
                     "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
                     "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
                     "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
                     "POSSIBILITY OF SUCH DAMAGE."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
                     "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. "
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
                     "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
                     "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
                     "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
                     "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
                     "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
                     "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This "
                "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
                "received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., "
                "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
                "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
                "received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "ISC": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
            "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
            "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
            "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
            "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
            "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
            "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
                  "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
                  "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
                  "relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
                  "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
                  "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                  "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
                  "USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
             "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
             "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
             "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
             "altered from any source distribution."],
}

# How works name a licence in one sentence, and the names of licences in such sentences.
NOTICES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}."]
NAMES = {
    "AGPL-3.0": ["the GNU Affero General Public License v3.0", "the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["the Apache License 2.0", "the Apache License, Version 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0"],
    "GPL-2.0": ["the GNU General Public License v2.0", "the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License v3.0", "the GNU General Public License, version 3"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License v2.1", "the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License v3.0", "the GNU Lesser General Public License, version 3"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License 2.0"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
}


def normal_words(text: str) -> list[str]:
    """A template's words, normalised like those of a unit."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigrams(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def with_notices(texts: dict[str, list[str]], names: dict[str, list[str]], notices: list[str]) -> dict[str, list[str]]:
    """``texts`` and behind them every notice with every name of the licence, and its SPDX line; no two with the same bigrams."""
    out: dict[str, list[str]] = {}
    for licence in sorted({*texts, *names}):
        said = [notice.format(name) for name in names.get(licence, ()) for notice in notices]
        spdx = [f"SPDX-License-Identifier: {licence}"] if licence in names else []
        seen: dict[tuple, str] = {}
        for text in [*texts.get(licence, ()), *said, *spdx]:
            seen.setdefault(tuple(bigrams(text)), text)
        out[licence] = list(seen.values())
    return out


TEMPLATES = with_notices(TEXTS, NAMES, NOTICES)


def bounds(size: int, threshold: str = THRESHOLD) -> tuple[int, int]:
    """Least and greatest number of bigrams of a unit that can match a template of ``size``."""
    t = Fraction(threshold)
    return ceil(t * size / (2 - t)), floor(size * (2 - t) / t)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _templates(templates: dict[str, list[str]], threshold: str) -> list[tuple[str, int, int, list[str]]]:
    rows = [(name, bigrams(text)) for name, texts in sorted(templates.items()) for text in texts]
    return [(name, *bounds(len(own), threshold), own) for name, own in rows]


def _needed(size: int, low: int, threshold: str) -> int:
    """Least number of a template's bigrams in any unit that matches it."""
    return ceil(Fraction(threshold) * (low + size) / 2)


def _template_array(rows: list[tuple[str, int, int, list[str]]], threshold: str) -> Column:
    return F.array(*[F.struct(F.lit(number).alias("number"), F.lit(name).alias("license"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(_needed(len(own), low, threshold)).alias("need"),
                              F.split(F.lit("\n".join(own)), "\n").alias("own")) for number, (name, low, high, own) in enumerate(rows)])


def _once(column: Column) -> Column:
    """``column``, computed once per row: no filter above repeats it and no later expression takes it in. The
    optimizer keeps apart what depends on the row's place; a bare ``rand() >= 0`` it would fold to true."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _pairs(items: str, join) -> Column:
    return F.zip_with(F.slice(items, 1, F.size(items) - 1), F.slice(items, 2, F.size(items) - 1), join)


def candidates(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: str = THRESHOLD) -> DataFrame:
    """(doc, row, text, chosen): the texts with enough of a template's bigrams, wherever they stand, and these templates. Found once and stored."""
    rows = _templates(templates, threshold)
    known = sorted({gram for *_, own in rows for gram in own})
    words = docs.select(id_key().alias("doc"), "text", _once(_words(F.col("text"))).alias("words"))
    grams = F.filter(_pairs("words", lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isin(known))
    least = min(_needed(len(own), low, threshold) for _, low, _, own in rows)
    shared = words.select("doc", "text", _once(F.array_distinct(grams)).alias("shared")).filter(F.size("shared") >= least)
    enough = F.filter(_template_array(rows, threshold), lambda t: (F.size("shared") >= t["need"]) & (F.size(F.array_intersect(t["own"], "shared")) >= t["need"]))
    numbers = shared.select("doc", "text", _once(F.transform(enough, lambda t: t["number"])).alias("numbers")).filter(F.size("numbers") > 0)
    found = stored(numbers.withColumn("row", F.monotonically_increasing_id()), "licence-candidates")
    return found.select("doc", "row", "text", _once(F.filter(_template_array(rows, threshold), lambda t: F.array_contains("numbers", t["number"]))).alias("chosen"))


def _unit_matches(chosen: DataFrame, threshold: str) -> DataFrame:
    """Matches of single lines and of whole texts (line 0)."""
    lines = chosen.select("doc", "text", "chosen", F.split("text", "\n").alias("lines"))
    units = lines.select("doc", "chosen", F.posexplode(F.when(F.size("lines") > 1, F.concat(F.array("text"), F.col("lines"))).otherwise(F.concat(F.array(F.lit("")), F.col("lines")))).alias("line_no", "unit"))
    words = units.select("doc", "chosen", "line_no", _once(_words(F.col("unit"))).alias("words"))
    grams = words.select("doc", "chosen", "line_no", _once(F.array_distinct(_pairs("words", lambda a, b: F.concat(a, F.lit(" "), b)))).alias("grams"))
    found = F.transform(
        F.filter("chosen", lambda t: F.size("grams").between(t["low"], t["high"])),
        lambda t: F.struct(t["license"].alias("license"), (2 * F.size(F.array_intersect("grams", t["own"])) / (F.size("grams") + F.size(t["own"]))).alias("dice")))
    good = grams.select("doc", "line_no", _once(F.filter(found, lambda h: h["dice"] >= float(threshold))).alias("good"))
    best = good.withColumn("top", _once(F.array_max(F.transform("good", lambda h: h["dice"]))))
    hits = best.select("doc", "line_no", F.explode(F.filter("good", lambda h: h["dice"] == F.col("top"))).alias("hit"))
    return hits.select("doc", "line_no", "hit.license", "hit.dice")


def _rank(places: str, at: Column) -> Column:
    """How many of the ascending ``places`` are below ``at``: a binary search."""
    span = F.struct(F.lit(0).alias("low"), F.size(places).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = F.get(places, middle) < at
        done = acc["low"] >= acc["high"]
        return F.struct(F.when(done | ~below, acc["low"]).otherwise(middle + 1).alias("low"), F.when(done | below, acc["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), span, halve, lambda acc: acc["low"])


def _run_matches(chosen: DataFrame, threshold: str) -> DataFrame:
    """Per text and template the best run of each first line that matches; a run begins and ends with a word and has two lines or more.

    Every bigram knows where it stood before, so the different ones of a run are those that stood nowhere before
    since its first line, and one pass from a first line counts all its runs. Bigrams new to the text bound how
    far a run can reach, and the template's bigrams up to there whether it can match at all. A run whose first line
    starts none of these is passed over: without that line it is a better one.
    """
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.transform(F.filter(_words(line), lambda w: w != ""), lambda w: F.struct(w.alias("word"), (i + 1).alias("line"))))
    own = F.struct("doc", "row").alias("doc")
    words = chosen.filter(F.instr("text", "\n") > 0).select(own, "chosen", _once(F.flatten(lines)).alias("words"))
    pairs = words.select("doc", "chosen", _pairs("words", lambda a, b: F.struct(F.concat(a["word"], F.lit(" "), b["word"]).alias("gram"), a["line"].alias("first"), b["line"].alias("last"))).alias("pairs"))
    order = pairs.select("doc", "chosen", _once(F.sort_array(F.transform("pairs", lambda x, i: F.struct(x["gram"].alias("gram"), (i + 1).alias("at"), x["first"].alias("first"), x["last"].alias("last"))))).alias("order")).filter(F.size("order") > 0)
    before = F.concat(F.slice("order", 1, 1), F.slice("order", 1, F.size("order") - 1))
    back = order.select("doc", "chosen", _once(F.sort_array(F.zip_with("order", before, lambda x, y: F.struct(
        x["at"].alias("at"), x["first"].alias("first"), x["last"].alias("last"), x["gram"].alias("gram"),
        F.when((x["gram"] == y["gram"]) & (y["at"] < x["at"]), y["at"]).otherwise(0).alias("before"))))).alias("back"))
    after = F.concat(F.slice("back", 2, F.size("back") - 1), F.array(F.lit(None).cast(back.schema["back"].dataType.elementType)))
    places = back.select("doc", "chosen", _once(F.zip_with("back", after, lambda x, y: F.struct(*[x[c].alias(c) for c in ("at", "first", "last", "gram", "before")], (y["last"].isNull() | (y["last"] > x["last"])).alias("ends")))).alias("places"),
                         _once(F.transform(F.filter("back", lambda x: x["before"] == 0), lambda x: x["at"])).alias("news"))
    each = places.select("doc", "places", "news", F.explode("chosen").alias("t"))
    marked = each.select("doc", "news", "t.license", "t.low", "t.high", "t.need", F.size("t.own").alias("size"),
                         _once(F.transform("places", lambda x: F.struct(*[x[c].alias(c) for c in ("at", "first", "last", "before", "ends")], F.array_contains("t.own", x["gram"]).alias("mark")))).alias("places"))
    marks = marked.withColumn("marks", _once(F.transform(F.filter("places", lambda x: x["mark"]), lambda x: x["at"])))
    lines_at = F.filter("places", lambda x, i: (i == 0) | (F.get("places", i - 1)["first"] < x["first"]))
    starting = F.array_distinct(F.transform(F.filter("places", lambda x: x["mark"]), lambda x: x["first"]))
    starts = marks.withColumn("lines_at", _once(lines_at)).withColumn("starting", _once(starting)).withColumn("starts", _once(F.transform(
        F.filter("lines_at", lambda x: F.array_contains("starting", x["first"])),
        lambda x: F.struct(x["at"].alias("at"), x["first"].alias("line"), F.coalesce(F.get("news", _rank("news", x["at"]) + F.col("high")) - 1, F.size("places")).alias("until")))))
    dense = starts.withColumn("dense", _once(F.filter("starts", lambda s: _rank("marks", s["until"] + 1) - _rank("marks", s["at"]) >= F.col("need"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"))

    def step(acc: Column, x: Column, start: Column) -> Column:
        new = x["before"] < start["at"]
        n, shared = acc["n"] + new.cast("int"), acc["shared"] + (new & x["mark"]).cast("int")
        fits = x["ends"] & (x["last"] > start["line"])
        return F.struct(n.alias("n"), shared.alias("shared"), F.when(fits, F.greatest(acc["dice"], 2 * shared / (n + F.col("size")))).otherwise(acc["dice"]).alias("dice"))

    best = F.transform("dense", lambda s: F.struct(s["line"].alias("line_no"), F.aggregate(
        F.slice("places", s["at"], s["until"] - s["at"] + 1), none, lambda acc, x: step(acc, x, s), lambda acc: acc["dice"]).alias("dice")))
    found = dense.filter(F.size("dense") > 0).select("doc", "license", _once(best).alias("best"))
    hits = found.select("doc", "license", F.explode("best").alias("hit")).filter(F.col("hit.dice") >= float(threshold))
    ranks = F.rank().over(Window.partitionBy("doc.row", "hit.line_no").orderBy(F.desc("hit.dice")))
    return hits.withColumn("rank", ranks).filter("rank = 1").select("doc.doc", "hit.line_no", "license", "hit.dice")


def matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: str = THRESHOLD) -> DataFrame:
    """(doc, line_no, license, dice) for each line, each whole text and the best runs of lines that match a template;
    a run has the number of its first line, and line 0 is the whole text, left out where the text is a single line.
    Of the templates that match a line, a whole text, or runs from the same first line on, only the most similar
    counts (for runs, of those with a bigram that begins in that line): notices of related licences differ in a word.
    DataFrame functions only, local to the row; the texts that may hold a template are stored first."""
    chosen = candidates(docs, templates, threshold)
    return _unit_matches(chosen, threshold).unionByName(_run_matches(chosen, threshold))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: str = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, line_no, n_licenses, licenses) per document: the best match, the line it stands in
    or begins with (0: the whole text), and all licences that are the best match of a unit.

    Ties go to the first line, then to the first licence in the alphabet. No match, and a null, empty or blank
    text, gives nulls, 0 and an empty string. Rows with the same doc_id are one document, and so are all rows
    without an id. Other columns are not read.
    """
    best = F.struct((-F.col("dice")).alias("less"), "line_no", "license")
    hits = matches(docs.select("doc_id", "text"), templates, threshold).withColumn("best", best)
    every = docs.select(id_key().alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"))
    rows = every.select("doc", "doc_id", F.lit(None).cast("string").alias("license"), F.lit(None).cast(hits.schema["best"].dataType).alias("best")).unionByName(
        hits.select("doc", F.lit(None).cast("bigint").alias("doc_id"), "license", "best"))
    per_doc = rows.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.min("best").alias("best"), F.array_sort(F.collect_set("license")).alias("found"))
    return per_doc.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"), F.col("best.line_no").cast("bigint").alias("line_no"),
                          F.size("found").cast("bigint").alias("n_licenses"), F.array_join("found", ",").alias("licenses"))


def scan_sql(templates: dict[str, list[str]] = TEMPLATES, threshold: str = THRESHOLD) -> str:
    """The same result in DuckDB's SQL where no text has a licence in some of its lines only: every line and whole text compared to every template."""
    rows = ",\n".join(f"({_literal(name)}, [{', '.join(map(_literal, own))}])" for name, _, _, own in _templates(templates, threshold))
    return f"""WITH templates(license, own) AS (VALUES {rows}),
units AS (
  SELECT doc_id, unnest(range(0, len(lines) + 1)) AS line_no, unnest(list_concat([CASE WHEN len(lines) > 1 THEN text ELSE '' END], lines)) AS unit
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)),
words AS (SELECT doc_id, line_no, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
hits AS (SELECT doc_id, line_no, license, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM grams, templates),
good AS (SELECT * FROM hits WHERE dice >= {threshold}::DOUBLE QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, line_no)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line_no, license) AS r FROM good),
every AS (SELECT doc_id, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS found FROM good GROUP BY doc_id)
SELECT d.doc_id, b.license, b.dice, b.line_no::BIGINT AS line_no, coalesce(e.n, 0)::BIGINT AS n_licenses, coalesce(e.found, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1 LEFT JOIN every e ON e.doc_id = d.doc_id"""
