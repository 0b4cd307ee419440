"""License scan: normalised text against license templates by the Dice coefficient of word bigrams.

DataFrame functions only. A document's segments are its lines, its paragraphs (parted by lines without a
letter or digit, so that comment signs part them too) and its whole text. A segment of n bigrams can reach
the threshold t only against templates of t/(2-t) to (2-t)/t times n bigrams, and must share one of any set
of a template's bigrams that holds one more than it could lack. The bigrams with a few chosen words are that
set: a text without any of these words is passed over unread, and almost every segment before any template
is compared.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

THRESHOLD = 0.8

# Notices by which works name their license, and full texts of the short licenses.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: What parts paragraphs: lines without a letter or digit.
BLANK_LINES = r"(?:\n[^\p{L}\p{N}\n]*)+\n"
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", _MIT),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return numbered([f"{a} {b}" for a, b in zip(words, words[1:])])


def numbered(bigrams: list[str]) -> list[str]:
    """Bigrams with their running number, so that sets of them are multisets of bigrams."""
    seen: dict[str, int] = {}
    out = []
    for b in bigrams:
        seen[b] = seen.get(b, 0) + 1
        out.append(f"{b} #{seen[b]}")
    return out


def chosen_words(templates: list[tuple[list[str], int]]) -> list[tuple[str, ...]]:
    """Words such that every template (bigrams, how many of them a match may not all lack) has that many bigrams with one of them. Greedy: the word that brings templates furthest. Words of few letters stand in any text and are chosen only as a bigram, with both its words."""
    left = [([set(g.split(" #")[0].split()) for g in grams], n) for grams, n in templates]
    need, chosen = [n for _, n in left], []
    while any(n > 0 for _, n in left):
        gain: dict[tuple[str, ...], float] = {}
        for (open_, n), all_ in zip(left, need):
            if n > 0:
                for c in {(w,) for words in open_ for w in words if len(w) > 5}:
                    gain[c] = gain.get(c, 0.0) + min(sum(c[0] in words for words in open_), n) / all_
                for words in open_:
                    c = tuple(sorted(words, key=lambda w: (-len(w), w)))
                    gain[c] = gain.get(c, 0.0) + len("".join(c)) / 1000
        best = max(sorted(gain), key=gain.get)
        chosen.append(best)
        left = [([words for words in open_ if not set(best) <= words], n - sum(set(best) <= words for words in open_)) for open_, n in left]
    return chosen


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def scan(documents: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, segment) for every segment (in lower case) and license at or over the threshold, by the license's best template.

    Null, empty and blank texts and segments of one word have no bigrams and match nothing; equal segments of a
    document count once; rows that repeat an id, or have none, share their matches; other columns are ignored; an
    empty table gives no rows.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = [(name, grams, len(grams)) for name, text in templates if (grams := template_bigrams(text))]
    held = chosen_words([(grams, n - math.ceil(n * low - 1e-9) + 1) for _, grams, n in known])
    rare = sorted({g for _, grams, _ in known for g in (re.sub(r" #\d+$", "", x) for x in grams) if any(set(c) <= set(g.split()) for c in held)})
    # a word that another one stands in is found with that one
    tested = [c for c in held if not any(len(d) == 1 and d != c and d[0] in w for w in c for d in held)]
    may_have = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains("low", F.lit(w)) for w in c]) for c in tested])
    text = F.col("low")
    segments = F.array_distinct(F.concat(F.split(text, r"\n"), F.split(text, BLANK_LINES), F.array(text)))
    rows = spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("low")).filter("low is not null"))
    # the test is part of the explode, as a filter would lower-case a text for each word anew, and before it is dealt
    parts = rows.select("doc_id", F.lower("low").alias("low")).select("doc_id", F.explode(F.when(may_have, segments)).alias("low")).filter(may_have)
    words = parts.select("doc_id", F.col("low").alias("segment"), F.split(normalised(F.col("low")), " ").alias("words"))
    least, most = min(n for _, _, n in known), max(n for _, _, n in known)
    words = words.filter((F.size("words") - 1 >= math.ceil(least * low - 1e-9)) & (F.size("words") - 1 <= math.floor(most * high + 1e-9)) & (F.size("words") > 1))
    pairs = F.expr("transform(sequence(1, size(words) - 1), i -> concat(words[i - 1], ' ', words[i]))")
    near = words.withColumn("bigrams", pairs).filter(F.arrays_overlap("bigrams", F.array(*map(F.lit, rare))))
    tagged = F.expr("transform(bigrams, (b, i) -> concat(b, ' #', size(filter(slice(bigrams, 1, i + 1), x -> x = b))))")
    near = near.select("doc_id", "segment", tagged.alias("bigrams"))
    n = F.size("bigrams")
    dice = {}
    for name, grams, size in known:
        score = F.when((n >= low * size - 1e-9) & (n <= high * size + 1e-9), 2 * F.size(F.array_intersect("bigrams", F.array(*map(F.lit, grams)))) / (n + size))
        dice.setdefault(name, []).append(F.coalesce(score, F.lit(0.0)))
    best = [F.struct(F.lit(name).alias("license"), (F.greatest(*s) if len(s) > 1 else s[0]).alias("dice")) for name, s in dice.items()]
    found = near.select("doc_id", "segment", F.explode(F.array(*best)).alias("m")).filter(F.col("m.dice") >= threshold)
    return found.select("doc_id", "m.license", "m.dice", "segment")


def licenses(documents: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, license (best match, ties to the first name; else null), dice (0 without), n_licenses."""
    found = scan(documents, id_col=id_col, **options).groupBy("doc_id", "license").agg(F.max("dice").alias("dice"))
    best = found.groupBy("doc_id").agg(F.min(F.struct((-F.col("dice")).alias("least"), "license")).alias("best"), F.count("*").alias("n_licenses"))
    out = documents.select(F.col(id_col).alias("doc_id")).join(best.withColumnRenamed("doc_id", "known"), F.col("doc_id").eqNullSafe(F.col("known")), "left")
    return out.select("doc_id", F.col("best.license").alias("license"), F.coalesce(-F.col("best.least"), F.lit(0.0)).alias("dice"), F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"))
