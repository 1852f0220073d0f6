"""License scans by conditional compression.

Candidate blocks are the words around each licensing cue, whatever lines they stand on, as far to each
side as the longest notice reaches; blocks that meet are one. A block's words are compressed alone and
with each template as raw zstandard dictionary; templates are ranked by the share of their own
compressed size by which they make the block smaller, and those that save nothing are out. Every other
template is then confirmed by exact wording, in that order: its words are laid on the block's in
order, up to SPREAD words to each side of its rarest key word; every key word (name, version) must be
met as it stands, and at most MAX_MISSING of the template's words may be missing. All notices of a
block are hits, each from its first to its last word, with the differences in wording; a key word
belongs to one hit, that of the template that saves most, and words between two notices that both could
use are in the span of the first of them.

Defined cases: a null or empty text has no blocks; null doc_ids stay; repeated rows give repeated
rows; of templates that save as much the one with fewer differences wins, then the first listed; an
empty table gives an empty result; other columns are never read. Positions count code points.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts

MAX_MISSING = 0.2

# License notices in their usual wording, and the words that tell them apart.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    ("MIT", "Released under the MIT License.", ("mit",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission", "free", "charge", "software", "restriction")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "public", "2.0")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "source", "binary", "permitted")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    ("CC0-1.0", "Released into the public domain under CC0 1.0.", ("cc0", "1.0")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("permission", "sublicense", "merchantability", "noninfringement")),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", ("redistribution", "redistributions", "permitted", "disclaimed")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", ("redistribution", "redistributions", "permitted", "disclaimed", "neither", "endorse")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission", "fee", "granted", "copies")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache", "compliance", "unless", "governing")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu", "general", "public", "2", "option")),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general", "public", "3", "option")),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("as-is", "anyone", "commercial", "freely")),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost", "1.0")),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "public", "domain")),
)
# the first word of each cue and the cue, whose words a line break or comment mark may part
CUES = tuple((c.split()[0], re.compile(c.replace(" ", r"\W+"))) for c in ("licen", "redistribution", "permission is hereby", "public domain", "copyright", "source code form", "permission to use", "free software", "permission is granted"))
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
WANT = [WORD.findall(t.lower()) for _, t, _ in TEMPLATES]
#: words to each side of a key word on which a template is laid: room for some that were put in
SPREAD = max(map(len, WANT)) * 5 // 4


def lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # some letters change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks, left to right, without overlaps: the words around
    each cue, across lines, far enough for any notice that holds the cue."""
    low = lowered(text)
    at = sorted({m.start() for first, cue in CUES if first in low for m in cue.finditer(low)})
    if not at:
        return []
    words = [m.span() for m in WORD.finditer(low)]
    ends = [e for _, e in words]
    out: list[tuple[int, int]] = []
    last = -1
    for p in at:
        i = bisect.bisect_right(ends, p)
        lo, hi = max(0, i - 2 * SPREAD), min(len(words) - 1, i + 2 * SPREAD)
        if out and lo <= last:
            out[-1] = (out[-1][0], ends[hi])
        else:
            out.append((words[lo][0], ends[hi]))
        last = hi
    return out


@functools.lru_cache(maxsize=1)
def _compressors():
    plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
    held = []
    for words in WANT:
        data = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.append(zstandard.ZstdCompressor(level=9, write_content_size=False, write_dict_id=False, dict_data=data))
    return plain, held, [len(plain.compress(" ".join(words).encode())) for words in WANT]


def reductions(words: list[str]) -> list[float]:
    """By how much each template, as dictionary, makes the block smaller, as a share of the
    template's own compressed size; marks and lines between the words do not weigh."""
    plain, held, own = _compressors()
    data = " ".join(words).encode("utf-8", "replace")
    alone = len(plain.compress(data))
    return [(alone - len(c.compress(data))) / n for c, n in zip(held, own)]


def _outward(want: list[str], have: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """(missing, pairs): `want` laid in order on a start of `have`, as few words missing as can be,
    and then as few passed over; pairs are the equal places."""
    n = len(have)
    skip = 1 / (n + 1)  # all words passed over cost less than one missing
    row = [j * skip for j in range(n + 1)]
    rows = [row]
    for w in want:
        new = [row[0] + 1]
        for j, h in enumerate(have):
            new.append(min(row[j + 1] + 1, new[j] + skip, row[j] if w == h else math.inf))
        row = new
        rows.append(row)
    i, j = len(want), min(range(n + 1), key=row.__getitem__)
    pairs = []
    while i:
        if j and want[i - 1] == have[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return len(want) - len(pairs), pairs[::-1]


def wording(want: list[str], have: list[str], t: int, at: int) -> tuple[int, list[tuple[int, int]]]:
    """(missing, pairs) of the template's words laid on the block's so that word `t` is on `at`."""
    lost, left = _outward(want[:t][::-1], have[max(0, at - SPREAD) : at][::-1])
    gone, right = _outward(want[t + 1 :], have[at + 1 : at + 1 + SPREAD])
    return lost + gone, [(t - 1 - i, at - 1 - j) for i, j in left[::-1]] + [(t, at)] + [(t + 1 + i, at + 1 + j) for i, j in right]


def differences(want: list[str], have: list[str], pairs: list[tuple[int, int]]) -> list[str]:
    """-word for a template's word that is missing, +word for one put in between."""
    out: list[str] = []
    i, j = 0, pairs[0][1]
    for x, y in [*pairs, (len(want), pairs[-1][1] + 1)]:
        out += [f"-{w}" for w in want[i:x]] + [f"+{w}" for w in have[j:y]]
        i, j = x + 1, y + 1
    return out


@functools.lru_cache(maxsize=20_000)
def confirmed(block: str) -> tuple[tuple[str, float, tuple[str, ...], int, int], ...]:
    """(license, share saved, wording differences, start, end) of every notice of a block, left to
    right. Every template whose keys are there is laid on each place of its rarest key, in the order of
    what the templates save. Two hits that need the same word are one notice: the first stays."""
    low = lowered(block)
    words = list(WORD.finditer(low))
    have = [m[0] for m in words]
    count = Counter(have)
    could = [rank for rank, (_, _, keys) in enumerate(TEMPLATES) if all(k in count for k in keys)]
    if not could:
        return ()
    saved = reductions(have)
    found = []
    for rank in could:
        if saved[rank] <= 0:
            continue
        want, keys = WANT[rank], TEMPLATES[rank][2]
        key = min((k for k in keys if want.count(k) == 1), key=lambda k: count[k])
        for at in [i for i, w in enumerate(have) if w == key]:
            missing, pairs = wording(want, have, want.index(key), at)
            named = {j for i, j in pairs if want[i] in keys}
            if missing > MAX_MISSING * len(want) or len({have[j] for j in named}) < len(keys):
                continue
            put_in = pairs[-1][1] - pairs[0][1] + 1 - len(pairs)
            found.append((-round(saved[rank], 2), (missing + put_in) / len(want), pairs[0][1], rank, named, pairs))
    taken: set[int] = set()
    covered: set[int] = set()
    out = []
    for _, _, _, rank, named, pairs in sorted(found, key=lambda f: f[:4]):
        if not named & taken:
            # a notice takes all its words as keys, so that no shorter one is read out of it
            taken |= {j for _, j in pairs if j not in covered} | named
            own = [j for _, j in pairs if j not in covered] or [j for _, j in pairs]
            covered.update(range(own[0], own[-1] + 1))
            out.append((TEMPLATES[rank][0], saved[rank], tuple(differences(WANT[rank], have, pairs)), words[own[0]].start(), words[own[-1]].end()))
    return tuple(sorted(out, key=lambda h: h[3:]))


def identify(block: str) -> tuple[str, float, tuple[str, ...]] | None:
    """(license, share saved, wording differences) of the hit of a block with fewest differences."""
    return min((h[:3] for h in confirmed(block)), key=lambda h: len(h[2]), default=None)


HIT = "array<struct<license:string,start:int,end:int,saved:double,differences:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, hits."""

    def kernel(ids, texts):
        counts, hits = [], []
        for t in texts:
            found, places = [], blocks(t)
            for s, e in places:
                for name, share, differ, start, end in confirmed(t[s:e]):
                    found.append({"license": name, "start": s + start, "end": s + end, "saved": round(share, 4), "differences": list(differ)})
            counts.append(len(places))
            hits.append(found)
        return {"doc_id": ids, "n_blocks": counts, "hits": hits}

    return map_texts(docs, kernel, f"doc_id long, n_blocks long, hits {HIT}")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h.license))), ",")
    spans = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h.license, h.start.cast("string"), h.end.cast("string"))), ",")
    return rows.select("doc_id", "n_blocks", F.size("hits").cast("long").alias("n_hits"), names.alias("licenses"), spans.alias("spans"))
