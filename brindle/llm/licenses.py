"""License scans by the Dice coefficient over word bigrams, with DataFrame operations only.

The passages of a text are the text itself and each of its lines. A passage and a template are normalised
alike (lower case, letters and digits alone, one space between words) and compared by their sets of word
bigrams: twice what they share over the sum of their sizes. At a threshold t that can only be reached if the
sizes differ by a factor of at most (2 - t) / t, so that a template meets none but the passages of its
size; a passage of another size is never compared.

The templates are a fixed list that travels in the plan. A null or empty text, or one of a single word, has
no bigram and matches nothing. Repeated lines count once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

# Public licence texts and the notices that stand for them, as (licence, text).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", f"{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", _GPL_HEADER),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", _MPL_HEADER),
)


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once for all that a lambda makes of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bigrams(passage: Column) -> Column:
    """The distinct word bigrams of a passage, hashed."""
    words = F.filter(F.split(F.lower(passage), "[^a-z0-9]+"), lambda w: w != "")
    return _let(words, lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x))))


def matches(text: Column, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """array<struct<license, dice>>: each passage of text with each template that it comes up to."""
    known = [(name, template_bigrams(t)) for name, t in templates]
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    # Bounds are on counts, with room for the last bit of the factor.
    bounds = [(name, b, len(b) * least - 1e-9, len(b) * most + 1e-9) for name, b in known]
    hashed = [F.array(*(F.xxhash64(*(F.lit(w) for w in x.split(" "))) for x in b)) for _, b in known]

    def compared(own: Column) -> Column:
        def one(i: int) -> Column:
            name, b, low, high = bounds[i]
            dice = lambda: 2.0 * F.size(F.array_intersect(own, hashed[i])) / (F.size(own) + len(b))
            return F.when((F.size(own) >= low) & (F.size(own) <= high), _let(dice(), lambda d: F.when(d >= threshold - 1e-9, F.struct(F.lit(name).alias("license"), d.alias("dice")))))

        fits = (F.size(own) >= min(x[2] for x in bounds)) & (F.size(own) <= max(x[3] for x in bounds))
        none = F.array().cast("array<struct<license:string,dice:double>>")
        return F.when(fits, F.filter(F.array(*map(one, range(len(bounds)))), lambda m: m.isNotNull())).otherwise(none)

    whole = F.coalesce(text, F.lit(""))
    passages = F.array_distinct(F.concat(F.array(whole), F.split(whole, "\n")))
    return F.flatten(F.transform(passages, lambda p: _let(bigrams(p), compared)))


def scan(docs: DataFrame, text: str = "text", name: str = "matches", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a column of (license, dice) of its texts' passages. A column of that name is refused."""
    if name in docs.columns:
        raise ValueError(f"column {name} is there already")
    return docs.withColumn(name, matches(F.col(text), threshold))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "matches")
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 9).alias("best_dice"))


def runs(text: Column, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """array<struct<license, dice>>: of each template, the best run of two or more lines of text that comes up to it."""
    none = F.array().cast("array<bigint>")
    worded = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")), lambda w: F.size(w) > 0)
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x))
    # Of each line: its own bigrams, and the one that leads to it from the line before.
    lines = _let(worded, lambda ws: F.transform(ws, lambda w, i: F.struct(pairs(w).alias("own"), F.when(i > 0, F.array(F.xxhash64(F.element_at(F.get(ws, i - 1), -1), F.get(w, F.lit(0))))).otherwise(none).alias("before"))))

    def one(found: Column, text_bigrams: Column, name: str, b: list[str]) -> Column:
        known = F.array(*(F.xxhash64(*(F.lit(w) for w in x.split(" "))) for x in b))
        most = len(b) * (2 - threshold) / threshold + 1e-9

        def step(state: Column, line: Column) -> Column:
            own = F.array_union(state["own"], F.concat(line["before"], line["own"]))
            dice = lambda o: 2.0 * F.size(F.array_intersect(o, known)) / (F.size(o) + len(b))
            # A run only grows: once it has too many bigrams, none that begins there comes up any more.
            return F.when(F.size(state["own"]) > most, state).otherwise(_let(own, lambda o: F.struct(o.alias("own"), F.greatest(state["best"], dice(o)).alias("best"))))

        def best_from(i: Column) -> Column:
            start = F.struct(F.array_distinct(F.get(found, i)["own"]).alias("own"), F.lit(0.0).alias("best"))
            return F.aggregate(F.slice(found, i + 2, F.size(found)), start, step, lambda state: state["best"])

        # A first line that shares nothing with the template, and leads to nothing shared, only lowers the coefficient.
        begins = F.filter(F.sequence(F.lit(0), F.size(found) - 2), lambda i: F.arrays_overlap(F.concat(F.get(found, i)["own"], F.get(found, i + 1)["before"]), known))
        best = _let(F.array_max(F.transform(begins, best_from)), lambda d: F.when(d >= threshold - 1e-9, F.struct(F.lit(name).alias("license"), d.alias("dice"))))
        # To come up to the threshold, a run shares so many of the template's bigrams at least; so does its text.
        return F.when(F.size(F.array_intersect(text_bigrams, known)) >= len(b) * threshold / (2 - threshold) - 1e-9, best)

    def compared(found: Column) -> Column:
        every = F.array_distinct(F.flatten(F.transform(found, lambda x: F.concat(x["before"], x["own"]))))
        known = [(name, template_bigrams(t)) for name, t in templates]
        of_any = F.array(*(F.xxhash64(*(F.lit(w) for w in x.split(" "))) for x in sorted({x for _, b in known for x in b})))
        return _let(F.array_intersect(every, of_any), lambda shared: F.filter(F.array(*(one(found, shared, n, b) for n, b in known)), lambda m: m.isNotNull()))

    return _let(lines, lambda found: F.when(F.size(found) > 1, compared(found)).otherwise(F.array().cast("array<struct<license:string,dice:double>>")))


def op5_license_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5_licenses, with notices that take several lines of a longer text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", matches(F.col("text")).alias("m"), runs(F.col("text")).alias("r")).select("doc_id", F.size("r").cast("long").alias("n_runs"), F.concat("m", "r").alias("all"))
    names = F.array_sort(F.array_distinct(F.transform("all", lambda m: m["license"])))
    return found.select("doc_id", "n_runs", F.array_join(names, ",").alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("all", lambda m: m["dice"])), F.lit(0.0)), 9).alias("best_dice"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same in DuckDB, comparing every passage with every template.
OP5_SQL = f"""
WITH templates(t, license, text) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
passages AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, coalesce(text, '') AS p FROM documents
    UNION ALL SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p FROM documents)
),
worded AS (SELECT doc_id, p, regexp_extract_all(lower(p), '[a-z0-9]+') AS w FROM passages),
sets AS (SELECT doc_id, p, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM worded WHERE len(w) > 1),
known AS (SELECT t, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT t, license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM templates)),
scored AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(sets.b, known.b)) / (len(sets.b) + len(known.b)) AS dice FROM sets CROSS JOIN known),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best FROM scored WHERE dice >= {THRESHOLD} - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, round(coalesce(best, 0), 9) AS best_dice
FROM documents d LEFT JOIN hits USING (doc_id)
"""
