"""Licence scans, with DataFrame functions only: Dice coefficients of word bigrams against licence templates.

Short templates are compared with a text's lines, its paragraphs of more than one line, and the whole of it. All templates
are compared with windows of as many words as the template has, wherever one of its anchors stands in the text: the longest
bigram of each of some equal parts of it. So a notice is found as a paragraph, inside a longer line, wrapped over lines or as
a section of a longer text. Where no such window matches, all runs of words with as many bigrams as a match can have are
compared: a notice edited at its anchors, shortened or with words put in is found as well, and every such run of the threshold
or more shares a bigram's place with a match of its template. Words are runs of letters and digits, lower-cased; a segment's
set of distinct bigrams A is compared with each template's set B by 2 |A and B| / (|A| + |B|). For a coefficient of at least t,
|A| must lie within t / (2 - t) |B| and (2 - t) / t |B|, and A and B share the lower of these at least. So most segments meet no
template at all; bigrams are made only for segments whose word count allows one, or for texts that hold one of a template's
words without which too few of its bigrams are left. The templates are literals of the plan, few and fixed; projections over
the scan do the work, without a shuffle.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillset.llm.common import select_text

#: Parts that several notices share.
DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either {1} of "
    "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with "
    "this program. If not, see <https://www.gnu.org/licenses/>."
)
#: Names and notices of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. " + DISCLAIMER
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + DISCLAIMER
    ),
    "GPL-3.0-header": GNU.format("GNU General Public License", "version 3"),
    "GPL-2.0-header": GNU.format("GNU General Public License", "version 2"),
    "LGPL-3.0-header": GNU.format("GNU Lesser General Public License", "version 3"),
    "AGPL-3.0-header": GNU.format("GNU Affero General Public License", "version 3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-Rights-Reserved": "All rights reserved.",
}
THRESHOLD = 0.8
#: Templates of more bigrams are long; they have so many anchors, others one.
LONG, ANCHORS = 24, 5


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def anchors_of(text: str, most: int = ANCHORS) -> list[tuple[str, int]]:
    """(bigram, its place) of the longest bigram, one that the text has once, in each of `most` parts of a text; one in a short text."""
    w = words_of(text)
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
    parts = most if len(pairs) > LONG else 1
    found = []
    for k in range(parts):
        own = [(len(pairs[i]), -i) for i in range(k * len(pairs) // parts, (k + 1) * len(pairs) // parts) if pairs.count(pairs[i]) == 1]
        if own:
            found.append((pairs[-max(own)[1]], -max(own)[1]))
    return found


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The sizes that a set of a Dice coefficient of at least the threshold with a set of n can have."""
    return max(1, math.ceil(threshold * n / (2 - threshold) - 1e-9)), math.floor((2 - threshold) * n / threshold + 1e-9)


def needed_of(text: str, threshold: float) -> list[str]:
    """Words, long ones first, of which a segment that reaches the threshold has one: the bigrams without them are too few."""
    left, found = set(bigrams_of(text)), []
    low = size_bounds(len(left), threshold)[0]
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if len(left) < low:
            break
        found.append(word)
        left = {pair for pair in left if word not in pair.split(" ")}
    return found


def _listed(pairs: list[str]) -> str:
    """Bigrams, of letters, digits and blanks only, as SQL: one call to the JVM for all of them."""
    return ", ".join(f"'{pair}'" for pair in pairs)


def _words(segment: Column) -> Column:
    return F.filter(F.split(F.lower(segment), "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(pairs)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, license and dice (the best match; null and 0.0 without one), n_matches (segment and template pairs).

    Matches are segments of short templates, windows at anchors, and best runs away from a template's windows, those that overlap as one.
    Of equal coefficients the first name in alphabetical order is given. A null text counts as empty; texts of fewer than two
    words match nothing; repeated rows are scanned each; an empty table gives no rows.
    """
    sets = {k: bigrams_of(v) for k, v in templates.items()}
    if any(not v for v in sets.values()):
        raise ValueError("a template needs two words at least")
    bounds = {k: size_bounds(len(v), threshold) for k, v in sets.items()}
    short = [k for k, v in sets.items() if len(v) <= LONG]
    low, high = (min(bounds[k][0] for k in short), max(bounds[k][1] for k in short)) if short else (1, 0)
    none = F.array().cast("array<string>")
    kind = "array<struct<dice:double,license:string>>"
    base = select_text(docs, id_col, text_col)
    wants = {k: F.expr(f"array({_listed(v)})") for k, v in sets.items()}
    known = sorted({pair for v in sets.values() for pair in v})
    told = sorted({word for text in templates.values() for word in needed_of(text, threshold)})
    raw = base.select("doc_id", "text", F.split(F.lower("text"), "[^a-z0-9]+").alias("raw"))
    split = raw.select(
        "doc_id", "text", F.split("text", "\n").alias("lines"), F.split("text", r"\n[ \t\r]*\n").alias("paragraphs"),
        # few texts hold such a word, and only these have windows
        F.when(F.arrays_overlap("raw", F.array(*map(F.lit, told)) if told else none), F.filter("raw", lambda w: w != "")).otherwise(none).alias("words"),
    )
    segments = F.concat(
        "lines",
        F.when(F.size("paragraphs") > 1, F.filter("paragraphs", lambda p: p.contains("\n"))).otherwise(none),
        F.when(F.size("lines") > 1, F.array("text")).otherwise(none),
    )
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    worded = split.select("doc_id", F.filter(F.transform(segments, _words), lambda w: F.size(w) - 1 >= low).alias("worded"), F.filter(pairs, lambda p: p.isNotNull()).alias("pairs"))
    # one pass through the bigrams finds those of all templates
    standing = F.expr(f"filter(transform(pairs, (p, i) -> CASE WHEN p IN ({_listed(known) or 'NULL'}) THEN named_struct('pair', p, 'i', i) END), h -> h IS NOT NULL)")
    worded = worded.select("doc_id", "worded", "pairs", standing.alias("hits"))
    # a text of k distinct words has k - 1 distinct bigrams at least, so neither bound needs the bigrams themselves
    paired = worded.select("doc_id", "pairs", "hits", F.transform(F.filter("worded", lambda w: F.size(F.array_distinct(w)) - 1 <= high), _bigrams).alias("sets"))

    def likeness(have: Column, name: str) -> Column:
        want, (a, b) = sets[name], bounds[name]
        dice = F.size(F.array_intersect(have, wants[name])) * 2.0 / (F.size(have) + len(want))
        return F.when(F.size(have).between(a, b), F.struct(dice.alias("dice"), F.lit(name).alias("license")))

    def compare(have: Column) -> Column:
        return F.filter(F.array(*[likeness(have, name) for name in short]).cast(kind), lambda x: x.isNotNull() & (x["dice"] >= threshold))

    placed = "array<struct<place:int,match:struct<dice:double,license:string>>>"

    def enough(name: str) -> Column:
        return F.size(F.array_intersect("known", wants[name])) >= bounds[name][0]

    def windows(name: str) -> Column:
        """Matches of the windows at the template's anchors, each with the place of its first bigram (counted from 1)."""
        size = len(words_of(templates[name])) - 1
        places = {pair: at for pair, at in anchors_of(templates[name])}
        if not places:
            return F.array().cast(placed)
        own = F.filter("hits", lambda h: h["pair"].isin(list(places)))
        begin = lambda h: functools.reduce(lambda other, pair: F.when(h["pair"] == pair, h["i"] - places[pair] + 1).otherwise(other), places, F.lit(0))
        # the column is read twice, so it is not copied into the lambda; what lies before or behind the text is left out
        cut = lambda s: F.slice("pairs", F.greatest(s, F.lit(1)), F.greatest(F.least(s + size, F.size("pairs") + 1) - F.greatest(s, F.lit(1)), F.lit(0)))
        held = F.transform(F.array_distinct(F.transform(own, begin)), lambda s: F.struct(s.alias("place"), likeness(F.array_distinct(cut(s)), name).alias("match")))
        found = F.filter(held, lambda x: x["match"].isNotNull() & (x["match"]["dice"] >= threshold))
        return F.when(enough(name), found.cast(placed)).otherwise(F.array().cast(placed))

    def spots(k: int, name: str) -> Column:
        """Places of the template's bigrams outside of its windows that match."""
        size = len(words_of(templates[name])) - 1
        covered = f"flatten(transform(windows[{k}], x -> sequence(x.place, x.place + {size - 1})))"
        own = F.expr(f"array_except(transform(filter(hits, h -> h.pair IN ({_listed(sets[name])})), h -> h.i + 1), {covered})")
        return F.when(enough(name), own).otherwise(F.array().cast("array<int>"))

    def runs(k: int, name: str) -> Column:
        """Matches of the runs that share no place with a window that matches: the best from each place of a template's bigram on, overlapping ones as one."""
        n, (least, most) = len(sets[name]), bounds[name]
        # a match has `least` of the template's bigrams within `most` places
        dense = f"filter(transform(spots[{k}], (s, j) -> CASE WHEN get(spots[{k}], j + {least - 1}) < s + {most} THEN s END), s -> s IS NOT NULL)"
        window = f"coalesce(array_min(transform(filter(windows[{k}], x -> x.place > s), x -> x.place)) - 1, size(pairs))"
        # a bigram is new in the run from s on if it stood last before s
        steps = (
            f"transform(sequence(s, least(s + {most - 1}, size(pairs), {window})), i -> named_struct('i', i, 'new', int(prior[i - 1] < s), "
            f"'hit', int(prior[i - 1] < s AND pairs[i - 1] IN ({_listed(sets[name])}))))"
        )
        dice = f"double(2 * (r.hits + x.hit)) / double(r.size + x.new + {n})"
        run = (
            f"aggregate({steps}, named_struct('size', 0, 'hits', 0, 'dice', 0D, 'last', 0), (r, x) -> named_struct('size', r.size + x.new, 'hits', r.hits + x.hit, "
            f"'dice', greatest(r.dice, {dice}), 'last', CASE WHEN {dice} > r.dice THEN x.i ELSE r.last END))"
        )
        ran = f"filter(transform({dense}, s -> named_struct('s', s, 'run', {run})), x -> x.run.dice >= double({threshold!r}))"
        dices = (
            f"aggregate({ran}, named_struct('last', 0, 'dice', 0D, 'done', cast(array() AS array<double>)), (r, x) -> named_struct('last', greatest(r.last, x.run.last), "
            "'dice', CASE WHEN x.s > r.last THEN x.run.dice ELSE greatest(r.dice, x.run.dice) END, "
            "'done', CASE WHEN x.s > r.last THEN concat(r.done, array(r.dice)) ELSE r.done END), r -> filter(concat(r.done, array(r.dice)), d -> d > 0))"
        )
        found = F.transform(F.expr(dices), lambda d: F.struct(d.alias("dice"), F.lit(name).alias("license"))).cast(kind)
        return F.when(F.col("prior").isNotNull() & F.expr(f"size(spots[{k}]) >= {least}"), found).otherwise(F.array().cast(kind))

    # the last place before it of each bigram, by their order; only for texts whose spots may hold a match
    stood = (
        "transform(array_sort(zip_with(ordered, slice(concat(array(cast(NULL AS struct<pair:string,i:int>)), ordered), 1, size(ordered)), "
        "(x, y) -> named_struct('i', x.i, 'prior', CASE WHEN x.pair = y.pair THEN y.i ELSE 0 END))), x -> x.prior)"
    )
    dense = " OR ".join(f"size(spots[{k}]) >= {bounds[name][0]}" for k, name in enumerate(templates)) or "false"
    some = F.size("hits") > 0
    seen = paired.select("doc_id", "pairs", "hits", "sets", F.array_distinct(F.transform("hits", lambda h: h["pair"])).alias("known"))
    shown = seen.select("doc_id", "pairs", "hits", "sets", "known", F.when(some, F.array(*map(windows, templates))).alias("windows"))
    left = shown.select("doc_id", "pairs", "sets", "windows", F.when(some, F.array(*[spots(k, name) for k, name in enumerate(templates)])).alias("spots"))
    ordered = left.select("doc_id", "pairs", "sets", "windows", "spots", F.expr(f"CASE WHEN {dense} THEN array_sort(transform(pairs, (p, i) -> named_struct('pair', p, 'i', i + 1))) END AS ordered"))
    paired = ordered.select("doc_id", "pairs", "sets", "windows", "spots", F.expr(f"CASE WHEN ordered IS NOT NULL THEN {stood} END AS prior"))
    inside = F.when(F.col("windows").isNotNull(), F.concat(F.transform(F.flatten("windows"), lambda x: x["match"]), *[runs(k, name) for k, name in enumerate(templates)])).otherwise(F.array().cast(kind))
    matches = F.concat(F.coalesce(F.flatten(F.transform("sets", compare)).cast(kind), F.array().cast(kind)), inside)
    best = F.array_sort(F.col("matches"), lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1).when(x["license"] < y["license"], -1).when(x["license"] > y["license"], 1).otherwise(0))
    picked = paired.select("doc_id", matches.alias("matches")).select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.get(best, F.lit(0)).alias("best"))
    return picked.select("doc_id", F.col("best.license").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), "n_matches")
