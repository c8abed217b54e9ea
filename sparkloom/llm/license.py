"""License scan by a positional index of rare words, in DataFrame functions only.

A template is a licence's whole text or notice, of which one run of words, the
key phrase, is mandatory. The words' document frequencies are counted over the
whole table; of every template the ``RARE`` words with the highest IDF, and the
two rarest of its key phrase, go to the index with their places in it. A file's
places of indexed words, less the postings' places, are starts at which the
template may lie; the starts on which two postings agree are verified: the key
phrase must stand there word by word. The share of the template's IDF whose words
are found at the right relative places is the match's score.

Base phrases are templates of their own, all key phrase, so each of their places
is found.

Nothing is shuffled but the words' counts; an expression's size depends on the
number of templates alone.

Cases: null text is empty; texts without words have no match, score 0; rows that
repeat a doc_id are scanned each on its own; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are runs of these; A-Z is lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Licences and their notices as they are published.
MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD_HEAD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.
"""
UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.
"""
GNU = """
This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of
the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL = """
This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which
is available at https://www.eclipse.org/legal/epl-2.0.
"""
CC0 = """
To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty. You should have received a
copy of the CC0 Public Domain Dedication along with this software. If not, see
<http://creativecommons.org/publicdomain/zero/1.0/>.
"""

#: Templates of this scan: label, key phrase, whole text.
TEMPLATES = (
    ("agpl", "gnu affero general public license", GNU.format(name="GNU Affero General Public License", version=3)),
    ("all-rights-reserved", "all rights reserved", "Copyright. All rights reserved."),
    ("apache-2.0", "apache license version 2 0", APACHE),
    ("bsd", "redistribution and use in source and binary forms", BSD_HEAD + BSD_TAIL),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("cc-by-4.0", "cc by 4 0", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "cc by nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "cc0 public domain dedication", CC0),
    ("cc0-1.0", "cc0 1 0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("creative-commons", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("epl", "eclipse public license", EPL),
    ("gpl-2.0", "gnu general public license version 2", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-3.0", "gnu general public license version 3", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("gpl-notice", "under the terms of the gnu general public license", GNU.format(name="GNU General Public License", version=3)),
    ("isc", "permission to use copy modify and or distribute this software", ISC),
    ("lgpl", "gnu lesser general public license", GNU.format(name="GNU Lesser General Public License", version=3)),
    ("mit-text", "permission is hereby granted free of charge", MIT),
    ("mpl", "mozilla public license", MPL),
    ("unlicense", "released into the public domain", UNLICENSE),
    ("zlib", "altered source versions must be plainly marked as such", ZLIB),
)
#: Words of a template, by IDF, that are indexed besides the two rarest of its key phrase.
RARE, RARE_KEY = 6, 2


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def templates() -> list[tuple[str, list[str], list[str], int]]:
    """(label, key phrase, words, place of the key phrase in them) of base phrases and templates."""
    out = [(label, phrase.split(), phrase.split(), 0) for phrase, label in BASE]
    for label, key, text in TEMPLATES:
        phrase, body = key.split(), plain_words(text)
        out.append((label, phrase, body, next(i for i in range(len(body)) if body[i : i + len(phrase)] == phrase)))
    return out


def words_of(text: Column) -> Column:
    """All words of a text, A-Z lower-cased; null is empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def vocabulary() -> list[str]:
    return sorted({w for _, _, body, _ in templates() for w in body})


def idf_table(docs: DataFrame) -> dict[str, float]:
    """IDF of every template word over all ``docs``: one row for each word comes back."""
    known = vocabulary()
    present = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, known)))
    rows = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    count = {r.word: r.n for r in rows}  # "" stands once in each document
    total = count.get("", 0)
    return {w: math.log((total + 1) / (count.get(w, 0) + 0.5)) for w in known}


def postings(phrase: list[str], body: list[str], at: int, idf: dict[str, float]) -> list[tuple[str, list[int]]]:
    """(word, its places in the template) of the indexed words: the template's rarest and its key phrase's rarest."""
    rarest = lambda words, n: sorted(dict.fromkeys(words), key=lambda w: (-idf[w], w))[:n]
    chosen = dict.fromkeys([*rarest(phrase, RARE_KEY), *rarest(body, RARE)])
    return [(w, [i for i, x in enumerate(body) if x == w]) for w in chosen]


def _words_sql(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _starts(phrase: list[str], body: list[str], at: int, idf: dict[str, float]) -> str:
    """SQL: places (words from 0) of verified key phrases, at starts of the template on which two postings agree."""
    found = []
    for word, places in postings(phrase, body, at, idf):
        begins = ", ".join(f"h.place - {i - at}" for i in places)
        found.append(f"flatten(transform(filter(hits, h -> h.word = '{word}'), h -> array({begins})))")
    votes = f"array_sort(concat({', '.join(found)}))"
    # Equal starts stand side by side; one is kept that has an equal one behind it.
    agreed = f"transform(array({votes}), v -> array_distinct(filter(v, (s, i) -> get(v, i + 1) <=> s)))[0]" if len(found) > 1 else f"array_distinct({votes})"
    return f"filter({agreed}, s -> s >= 0 AND slice(words, greatest(s, 0) + 1, {len(phrase)}) = {_words_sql(phrase)})"


def _laid(label: str, phrase: list[str], body: list[str], at: int, idf: dict[str, float]) -> str:
    """SQL: (label, place, n_words, score) for each verified place of the key phrase."""
    weights = [max(idf[w], 1e-6) for w in body]
    weight = "array(" + ", ".join(f"{w!r}D" for w in weights) + ")"
    seen = f"aggregate(transform({_words_sql(body)}, (w, i) -> IF(get(words, s - {at} + i) <=> w, get({weight}, i), 0D)), 0D, (a, x) -> a + x)"
    return f"transform({_starts(phrase, body, at, idf)}, s -> named_struct('label', '{label}', 'place', CAST(s AS BIGINT), 'n_words', {len(phrase)}, 'score', least(1D, {seen} / {sum(weights)!r}D)))"


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, base: places of base phrases (label, place), and matches
    of all templates: array of (label, place, n_words, score)."""
    idf = idf_table(docs) if idf is None else idf
    indexed = sorted({w for _, *own in templates() for w, _ in postings(*own, idf)})
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # Places of indexed words alone; most texts have none, and then nothing more is looked at.
    listed = ", ".join(f"'{w}'" for w in indexed)
    places = f"transform(filter(sequence(0, size(words) - 1), i -> get(words, i) IN ({listed})), i -> named_struct('place', i, 'word', get(words, i)))"
    rows = words.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.expr(f"IF(arrays_overlap(words, {_words_sql(indexed)}), {places}, NULL)").alias("hits"))
    matches = "concat(" + ", ".join(_laid(*template, idf) for template in templates()) + ")"
    empty = "CAST(array() AS ARRAY<STRUCT<label: STRING, place: BIGINT, n_words: INT, score: DOUBLE>>)"
    found = rows.select("doc_id", "n_words", F.expr(f"IF(size(hits) > 0, {matches}, {empty})").alias("matches"))
    base = F.filter("matches", lambda m: m["label"].isin([label for _, label in BASE]))
    return found.select("doc_id", "n_words", base.alias("base"), "matches")


def label_columns(scanned: DataFrame) -> DataFrame:
    """The scan as columns: n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def joined(matches: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    places = F.transform("base", lambda m: m["place"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return scanned.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined("base").alias("base_labels"), joined("matches").alias("labels"), best.alias("score"))
