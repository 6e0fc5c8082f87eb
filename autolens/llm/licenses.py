"""License scans by patience alignment against templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, plain_text

#: Share of the words of template and passage that must be aligned.
COVERAGE = 0.8
KEPT_CHUNKS = 200_000
MAX_TEMPLATE_CHARS = 10_000_000

#: Notices of common licenses. Numbers stand for any number.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version 2.0"],
    "Apache-notice": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "MIT-warranty": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.",
    ],
    "ISC-warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-conditions": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ],
    "BSD-warranty": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation",
    ],
    "GPL-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
        "it and redistribute it freely, subject to the following restrictions",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "CC": ["This work is licensed under a Creative Commons Attribution"],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "GFDL": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
        "License, Version 1.3 or any later version published by the Free Software Foundation",
    ],
}
# Creative Commons notices differ in what follows "Attribution" and in the address.
for _terms, _short in (
    ("", "by"), ("-ShareAlike", "by-sa"), ("-NoDerivatives", "by-nd"), ("-NonCommercial", "by-nc"),
    ("-NonCommercial-ShareAlike", "by-nc-sa"), ("-NonCommercial-NoDerivatives", "by-nc-nd"),
):
    TEMPLATES.setdefault(f"CC-{_short.upper()}", []).append(
        f"This work is licensed under a Creative Commons Attribution{_terms} 4.0 International License. To view a copy of this "
        f"license, visit http://creativecommons.org/licenses/{_short}/4.0/"
    )
_WORDS = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    """Lower-case words; every number is the same word."""
    return ["0" if w[0].isdigit() else w for w in _WORDS.findall(text.lower())]


#: Function words start no search.
COMMON = frozenset("0 a an and any are as at be by for in is it of on or that the this to under use with without you".split())


class Index:
    """Templates as words, and which of them hold a word that may start a search.

    `templates` maps a license to its texts; a text needs a word that is no function word.
    They are sent with every task, so `MAX_TEMPLATE_CHARS` bounds their sum.
    """

    def __init__(self, templates: Mapping[str, Sequence[str]]) -> None:
        if sum(len(t) for texts in templates.values() for t in texts) > MAX_TEMPLATE_CHARS:
            raise ValueError(f"the templates have more than {MAX_TEMPLATE_CHARS} characters")
        self.words = [(name, words_of(t)) for name, texts in templates.items() for t in texts]
        self.seeds: dict[str, list[int]] = {}
        for i, (name, template) in enumerate(self.words):
            own = sorted(set(template) - COMMON)
            if not own:
                raise ValueError(f"a template of {name} has nothing but function words")
            for w in own:
                self.seeds.setdefault(w, []).append(i)


DEFAULT = Index(TEMPLATES)
#: (license, words of the template), and the templates of each seed.
WORDS, SEEDS = DEFAULT.words, DEFAULT.seeds


def needed_seeds(template: Sequence[str], coverage: float = COVERAGE) -> int:
    """Different seeds that a passage of at least `coverage` has: each word that may be missing
    takes one away at most."""
    missing = len(template) - ceil(coverage * len(template) - 1e-9)
    return max(1, len(set(template) - COMMON) - missing)


def longest_increasing(places: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
    result = []
    i = piles[-1] if piles else -1
    while i >= 0:
        result.append(i)
        i = before[i]
    return result[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words in `a` and `b`, rising in both.

    Words unique to both are the anchors, of which the longest increasing subsequence is
    kept. A gap next to an anchor first matches what is equal beside the anchor, then is
    aligned the same way. The outer ends are tied to nothing, since the text goes on there.
    """
    pairs: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b), False, False)]
    while waiting:
        i, j, k, m, from_left, from_right = waiting.pop()
        while from_left and i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while from_right and i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        at = {w: q for q, w in enumerate(b[k:m], k) if in_b[w] == 1}
        found = [(p, at[w]) for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in at]
        kept = [found[x] for x in longest_increasing([q for _, q in found])]
        pairs += kept
        if kept:
            edges = [(i - 1, k - 1), *kept, (j, m)]
            last = len(edges) - 2
            waiting += [
                (p + 1, q, r + 1, s, from_left or e > 0, from_right or e < last)
                for e, ((p, r), (q, s)) in enumerate(zip(edges, edges[1:], strict=False))
            ]
    return sorted(pairs)


def windows(places: Sequence[tuple[int, str]], template: Sequence[str], needed: int, coverage: float = COVERAGE) -> Iterator[tuple[int, int]]:
    """Stretches of the text that may hold a template.

    `places` are its seeds in the text. From each seed a stretch goes on for as many words
    as a passage may have, whatever seeds repeat; it counts if it has `needed` different
    ones. It reaches as far before the seed as a passage may. Where a seed comes more
    often than in the template, the stretch up to there is tried as well, since what follows
    may be another passage, whose words would hide those of this one; and the same for
    what lies before the seed.
    """
    size, most = len(template), Counter(template)
    longest = int(size / coverage + 1e-9)
    seen: Counter[str] = Counter()
    b = 0
    for a, (at, word) in enumerate(places):
        while b < len(places) and places[b][0] - at < longest:
            seen[places[b][1]] += 1
            b += 1
        if len(seen) >= needed:
            before, own, c = places[a - 1][0] + 1 if a else 0, Counter(), a
            while c < b and own[places[c][1]] < most[places[c][1]]:
                own[places[c][1]] += 1
                c += 1
            ends = {at + longest, places[c][0] if c < len(places) else at + longest}
            for start in {max(0, at - longest), max(before, at - longest)}:
                for end in ends:
                    yield start, end
        seen[word] -= 1
        if not seen[word]:
            del seen[word]


def passages(
    seeds: Sequence[tuple[int, str]], words: list[str], coverage: float = COVERAGE, index: Index = DEFAULT
) -> list[tuple[str, float, int, int, int]]:
    """`(license, coverage, first word, words, words aligned)` of every passage that covers a template.

    Coverage is the share of words aligned of the template or of the passage, the smaller.
    Windows overlap; of alignments that overlap for one template the best counts, the
    first of equals. Of templates that overlap, each counts for itself.
    """
    result = []
    places: dict[int, list[tuple[int, str]]] = {}
    for seed in seeds:
        for t in index.seeds[seed[1]]:
            places.setdefault(t, []).append(seed)
    for t, own in places.items():
        name, template = index.words[t]
        needed = needed_seeds(template, coverage)
        if len({w for _, w in own}) < needed:
            continue
        found: list[tuple[float, int, int, int]] = []
        for a, b in windows(own, template, needed, coverage):
            pairs = align(words[a:b], template)
            if not pairs:
                continue
            first, end = a + pairs[0][0], a + pairs[-1][0] + 1
            share = len(pairs) / max(len(template), end - first)
            if share >= coverage:
                found.append((share, first, end, len(pairs)))
        taken: list[tuple[int, int]] = []
        for share, first, end, aligned in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if all(end <= s or first >= e for s, e in taken):
                taken.append((first, end))
                result.append((name, share, first, end - first, aligned))
    return sorted(result, key=lambda x: (x[2], x[0], x[3]))


def scan(text: str, seeds: Sequence[tuple[int, str]], words: list[str], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """`(license, coverage, first word, words)` of every passage that covers a template, in order."""
    return [row[:4] for row in passages(seeds, words, coverage)]


def settled(found: Sequence[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of `passages` those that share no more than half of the shorter one's words with a better passage.

    Licenses of one family differ in a word or two, so that a text of one covers the templates of
    its kin as well, and one notice may begin like another. The more words are aligned the better,
    then the higher coverage, then what comes first and by name.
    """
    kept: list[tuple[str, float, int, int]] = []
    for *row, _ in sorted(found, key=lambda x: (-x[4], -x[1], x[2], x[0])):
        _, _, first, n = row
        if all(2 * (min(first + n, f + m) - max(first, f)) <= min(n, m) for _, _, f, m in kept):
            kept.append(tuple(row))
    return sorted(kept, key=lambda x: (x[2], x[0], x[3]))


def license_passages(
    docs: DataFrame, coverage: float = COVERAGE, templates: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """`(doc_id, license, coverage, first_word, n_words)`: a row for each passage that covers
    a license's template by at least `coverage`; texts are read whole. Of passages that cover
    each other's words the best is given (`settled`). `templates` replaces the notices above.

    Words are compared in lower case without punctuation, numbers as one word. Null and
    empty texts have no passage; null doc_ids stay null; a repeated row gives its passages
    again; other columns are ignored; an empty table gives no row. Rows are independent,
    and nothing is shuffled.
    """

    index = DEFAULT if templates is None else Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Recent(lambda chunk: not index.seeds.keys().isdisjoint(words_of(chunk)), KEPT_CHUNKS)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not any(map(cache.__getitem__, set(text.split()))):
                    continue
                words = words_of(text)
                seeds = [(p, w) for p, w in enumerate(words) if w in index.seeds]
                rows += [(doc_id, *found) for found in settled(passages(seeds, words, coverage, index))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "license", "coverage", "first_word", "n_words"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text")).mapInArrow(
        run, "doc_id bigint, license string, coverage double, first_word bigint, n_words bigint"
    )
