"""Licence scan: Dice coefficient of word bigrams against licence notices and licence texts, in DataFrame functions only.

Units of comparison are the lines of a text, its runs of one to `RUN` paragraphs (parts between blank lines; a run of one
line is that line already), and, where it has several lines, the whole text. So a notice on its own line, a notice
wrapped over several lines, and a licence text inside a longer document are found; a notice inside a paragraph much longer
than itself isn't. A unit is lower-cased (A-Z), every run of characters other than a-z, 0-9 and non-ASCII ones becomes one
space, and its set of distinct word bigrams is compared with each template's. Dice = 2 * common / (units + template).

A template can reach the threshold t only if  t / (2 - t) <= unit size / template size <= (2 - t) / t;
others are pruned before any set is intersected, units outside the bounds of all templates before their
bigrams are built. Before that, units without a marker are left out: at the threshold a unit shares at least t / (2 - t)
of a template's bigrams, so if the bigrams that hold one of some words are more than the rest, one of those words stands
in the unit. `markers` chooses such words, rare ones, for every template.

Cases: null or empty text, and text without any word: no units, no licence. A line of one word has no
bigram and cannot match. Equal scores: the alphabetically first licence. Repeated rows are scanned each.
Other columns of the input are ignored. Everything happens within a row: no shuffle, no group.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    program = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    warranty = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    return f"{program} {warranty} You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."


# Licence notices and licence texts as their publishers word them; a licence may have several.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_HEAD} 1. {_BSD_ONE} 2. {_BSD_TWO} {_BSD_TAIL}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD_HEAD} 1. {_BSD_ONE} 2. {_BSD_TWO} 3. {_BSD_THREE} {_BSD_TAIL}"),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
        "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("ISC", "Released under the ISC License."),
    (
        "ISC",
        f'{_GRANT} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT '
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
]
THRESHOLD = 0.8
RUN = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD, _WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[0-9A-Za-z]|[^\x00-\x7F]"
_BLANK = r"\n[ \t\r]*\n"
# Words of common prose: as markers they would let nearly every text through.
_COMMON = set(
    "a 0 above act action all along an and any are into such data direct special future possible required language being otherwise included binary conditions extent charge alter altered terms anyone arising as at author authors be benefit but by can claim code compile connection contract copies copy distribute documentation either even event express following for form free "
    "from general get has have holder holders how however if implied in including interest is it its kind large law laws limited loss make may means modify more must name names no not notice obtain of on one option or other out "
    "owner part particular person product products provided public publish purpose received released rights see sell shall so source subject substantial that the this those to under use used using version was way whether will "
    "with without work works write writing written you your".split()
)


def unit_words(text: Column) -> Column:
    """Normalised words of a text."""
    clean = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _NO_WORD, " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def word_bigrams(words: Column) -> Column:
    """Distinct bigrams of a list of words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def _template_bigrams(text: str) -> list[str]:
    kept = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower()).split()
    return sorted({" ".join(p) for p in zip(kept, kept[1:], strict=False)})


def markers(sets: list[list[str]], low: float) -> list[str]:
    """Words one of which stands in any unit that can match: for each template words whose bigrams are more than the 1 - low that a match can lack."""
    spread = Counter(w for s in sets for w in {w for b in s for w in b.split()})
    chosen: set[str] = set()
    for s in sets:
        lacking = len(s) * (1 - low)
        words = {w for b in s for w in b.split()}
        covered = {b for b in s if chosen & set(b.split())}
        while len(covered) <= lacking:
            gain = lambda w: (w not in _COMMON, len({b for b in s if w in b.split()} - covered), len(w), spread[w], w)  # noqa: B023, E731
            best = max((w for w in words - chosen if {b for b in s if w in b.split()} - covered), key=gain)
            chosen.add(best)
            covered |= {b for b in s if best in b.split()}
    return sorted(chosen)


def any_of(words: list[str]) -> str:
    """A pattern for any of some words that shares their beginnings, so a text is searched once and not once for each word."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(w[1:])
    branches = [first + any_of(rest) for first, rest in sorted(tails.items()) if first]
    joined = "|".join(branches)
    return (f"(?:{joined})?" if "" in tails else f"(?:{joined})") if branches else ""


def runs_of(paragraphs: Column) -> Column:
    """Runs of one to RUN paragraphs of a text that has several; a run of one line is that line already."""
    count = F.size(paragraphs)
    starts = F.when(count > 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), count - i + 1)), lambda n: F.array_join(F.slice(paragraphs, i, n), "\n"))))
    return F.filter(runs, lambda r: r.contains("\n"))


def count_units(lines: Column, paragraphs: Column, body: Column) -> Column:
    """Number of units with words, without building the runs: all runs of two and more, and those of one that have several lines."""
    count = F.size(paragraphs)
    each = F.transform(paragraphs, lambda p, i: F.least(F.lit(RUN), count - i) - F.when(p.contains("\n"), 0).otherwise(1))
    runs = F.when(count > 1, F.aggregate(each, F.lit(0), lambda a, n: a + n)).otherwise(0)
    whole = F.when((F.size(lines) > 1) & body.rlike(_WORD), 1).otherwise(0)
    return F.size(F.filter(lines, lambda u: u.rlike(_WORD))) + runs + whole


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: key, n_units (units with words), n_matches, licence, dice, licences.

    A unit matches its best template, if that is at or above the threshold. n_matches: matching units; licence
    and dice: the best match; licences: all units' matches, sorted, comma-joined (empty string for none)."""
    sets = [(name, _template_bigrams(body)) for name, body in sorted(templates)]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(s) for _, s in sets) * low, max(len(s) for _, s in sets) * high
    # struct<name, size, bigrams> of the templates, as one literal array
    shelf = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(s)).alias("size"), F.array(*[F.lit(b) for b in s]).alias("bigrams")) for n, s in sets])
    marked = rf"(?i)(?:^|[^0-9a-z]){any_of(markers([s for _, s in sets], low))}(?![0-9a-z])"

    # One step after another, so that no text is split or searched twice.
    frame = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"))
    has_word = lambda p: p.rlike(_WORD)
    frame = frame.select("_key", "_body", F.split("_body", "\n").alias("_lines"), F.filter(F.split("_body", _BLANK), has_word).alias("_paragraphs"), F.col("_body").rlike(marked).alias("_marked"))
    several = F.when(F.size("_lines") > 1, F.concat("_lines", runs_of(F.col("_paragraphs")), F.array("_body"))).otherwise(F.col("_lines"))
    # Distinct bigrams are at most words - 1, so fewer words than the lower bound cannot match. Longer units need their sets.
    units = F.filter(F.when(F.col("_marked"), several).otherwise(F.array().cast("array<string>")), lambda u: (F.length(u) > 2 * least) & u.rlike(marked))
    frame = frame.select("_key", count_units(F.col("_lines"), F.col("_paragraphs"), F.col("_body")).alias("n_units"), F.transform(units, unit_words).alias("_words"))
    sized = F.filter(F.transform(F.filter("_words", lambda w: F.size(w) - 1 >= least), word_bigrams), lambda b: F.size(b) <= most)
    frame = frame.select("_key", "n_units", sized.alias("_sets"))

    def scores(unit: Column) -> Column:
        near = F.filter(shelf, lambda t: (F.size(unit) >= t["size"] * low) & (F.size(unit) <= t["size"] * high))
        return F.transform(near, lambda t: F.struct((F.size(F.array_intersect(unit, t["bigrams"])) * 2.0 / (F.size(unit) + t["size"])).alias("dice"), t["name"].alias("name")))

    def best_of(found: Column) -> Column:
        none = F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name"))
        return F.aggregate(found, none, lambda a, s: F.when((s["dice"] > a["dice"]) | ((s["dice"] == a["dice"]) & (s["name"] < a["name"])), s).otherwise(a))

    frame = frame.select("_key", "n_units", F.filter(F.transform("_sets", lambda u: best_of(scores(u))), lambda s: s["dice"] >= threshold).alias("_hits"))
    frame = frame.select("_key", "n_units", "_hits", best_of(F.col("_hits")).alias("_best"))
    some = F.size("_hits") > 0
    return frame.select(
        F.col("_key").alias(key),
        F.col("n_units").cast("long").alias("n_units"),
        F.size("_hits").cast("long").alias("n_matches"),
        F.when(some, F.col("_best.name")).alias("licence"),
        F.when(some, F.round("_best.dice", 6)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda s: s["name"]))), ",").alias("licences"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The scan over `documents` in DuckDB SQL."""
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    clean = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    bigrams = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))".format
    return f"""
WITH shelf AS (SELECT name, list_filter(string_split({clean.format("body")}, ' '), lambda x: x <> '') AS w FROM (VALUES {quoted}) t(name, body)),
templates AS (SELECT name, {bigrams(w="w")} AS b FROM shelf),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), lambda p: regexp_matches(p, '[0-9A-Za-z]|[^\\x00-\\x7F]')) AS p FROM documents),
runs AS (SELECT doc_id, array_to_string(p[i:i + n - 1], chr(10)) AS u FROM (SELECT doc_id, p, i, unnest(range(1, least({RUN}, len(p) - i + 1) + 1)) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM lines WHERE len(p) > 1))),
units AS (SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_append(l, t) ELSE l END) AS u FROM lines UNION ALL SELECT doc_id, u FROM runs WHERE contains(u, chr(10))),
worded AS (SELECT doc_id, list_filter(string_split({clean.format("u")}, ' '), lambda x: x <> '') AS w FROM units),
sets AS (SELECT doc_id, row_number() OVER () AS unit, {bigrams(w="w")} AS b FROM worded WHERE len(w) > 0),
hits AS (SELECT doc_id, unit, name, 2.0::DOUBLE * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
         FROM sets s JOIN templates t ON len(s.b) >= len(t.b) * {threshold} / (2 - {threshold}) AND len(s.b) <= len(t.b) * (2 - {threshold}) / {threshold}),
good AS (SELECT doc_id, unit, max(dice) AS dice, first(name ORDER BY dice DESC, name) AS name FROM hits WHERE dice >= {threshold} GROUP BY doc_id, unit),
best AS (SELECT doc_id, count(*) AS n_matches, first(name ORDER BY dice DESC, name) AS licence, max(dice) AS dice,
                string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM good GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_units FROM sets GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_units, 0)::BIGINT AS n_units, coalesce(b.n_matches, 0)::BIGINT AS n_matches, b.licence, round(b.dice, 6) AS dice, coalesce(b.licences, '') AS licences
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN best b USING (doc_id)"""
