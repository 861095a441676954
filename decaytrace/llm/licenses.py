"""License scans: patience alignment of texts with license notices."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

# Public license notices, the wording that their owners ask users to put down.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT (grant)": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL (header)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_GNU = {
    "GPL": ("General", "1", "2", "3"), "LGPL (library)": ("Library General", "2"), "LGPL": ("Lesser General", "2.1", "3"), "AGPL": ("Affero General", "1", "3"),
}
for _name, (_title, *_versions) in _GNU.items():
    for _v in _versions:
        _id = f"{_name.split()[0]}-{_v if '.' in _v else _v + '.0'}"
        NOTICES.setdefault(_id, f"This work is licensed under the GNU {_title} Public License, version {_v}.")
        if _id != "GPL-3.0":  # that one is above, as GPL (header)
            _thing = "library" if "LGPL" in _name else "program"
            NOTICES[f"{_id} (header)"] = (
                f"This {_thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {_title} Public License as published "
                f"by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
            )
_TERMS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
        NOTICES.setdefault(f"CC-{_kind}-{_v}", f"Licensed under CC {_kind} {_v}.")
        _long = "-".join(_TERMS[t] for t in _kind.split("-"))
        NOTICES[f"CC-{_kind}-{_v} (name)"] = f"licensed under a Creative Commons {_long} {_v} License"
        if "ND" in _kind and _v != "4.0":  # the older versions' own name
            NOTICES[f"CC-{_kind}-{_v} (old name)"] = NOTICES[f"CC-{_kind}-{_v} (name)"].replace("NoDerivatives", "NoDerivs")
for _v in ("1.0", "1.1"):
    NOTICES[f"Apache-{_v}"] = f"Licensed under the Apache License, Version {_v}."
    NOTICES[f"MPL-{_v}"] = f"The contents of this file are subject to the Mozilla Public License Version {_v}"
for _v in ("1.0", "2.0"):
    NOTICES[f"EPL-{_v}"] = f"made available under the terms of the Eclipse Public License {_v}"
    NOTICES[f"EPL-{_v} (v)"] = f"made available under the terms of the Eclipse Public License v{_v}"
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO = (
    f"{NOTICES['BSD']}: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
NOTICES |= {
    "BSD-2-Clause": f"{_TWO} {_AS_IS}",
    "BSD-3-Clause": (
        f"{_TWO} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        f"without specific prior written permission. {_AS_IS}"
    ),
    "MIT (text)": (
        f"{NOTICES['MIT (grant)']}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "CC0-1.0 (waiver)": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

# Words that tell look-alikes apart. Those of a notice must all match, and no
# others may stand between its first and its last word; numbers count where the notice has one.
NUMBERS = frozenset(f"{v}{n}".encode() for v in ("", "v") for n in range(10))
DECIDING = frozenset(b"cc cc0 nc nd sa lesser affero library attribution noncommercial sharealike noderivatives noderivs neither endorse apache mozilla eclipse".split())

SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words; every ASCII character that is no letter or digit parts words."""
    return text.translate(SPACED).lower().split()


@dataclass(frozen=True)
class LicenseScan:
    """Settings of the scan: the notices, the least coverage of a notice, and the share of the
    words between the first and the last match that must match."""

    coverage: float = 0.8
    density: float = 0.6
    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES), hash=False)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest increasing subsequence of the second numbers, by patience piles."""
    tops: list[int] = []
    owner: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(owner[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [y]
        owner[pile : pile + 1] = [k]
    out, k = [], owner[-1] if owner else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Matching positions of two word lists, rising in both.

    Anchors are the words that occur once in either list; of them the longest increasing
    subsequence stays, and the gaps between anchors are aligned in the same way. A gap without
    anchors gives the equal words at its two ends.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = _rising([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if w in at])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Notices:
    """The notices as word lists, with the words that no covered text can lack.

    A text that covers a share c of n words lacks at most n - ceil(c * n) of them, so of any
    n - ceil(c * n) + 1 places of the notice it holds at least one: the longest words are taken.
    """

    def __init__(self, job: LicenseScan):
        self.job = job
        self.words = {name: words_of(t.encode()) for name, t in job.notices.items()}
        self.words = {name: w for name, w in self.words.items() if w}
        self.deciding = {name: DECIDING | (NUMBERS if NUMBERS.intersection(w) else frozenset()) for name, w in self.words.items()}
        # a program may be under the lesser license too
        self.must = {name: self.deciding[name].intersection(w) - {b"0"} - ({b"library"} if b"lesser" in w else set()) for name, w in self.words.items()}
        self.keys: dict[bytes, list[str]] = {}
        for name, w in self.words.items():
            needed = len(w) - math.ceil(job.coverage * len(w)) + 1
            for word in {x for x in sorted(w, key=lambda x: (-len(x), x))[:needed]}:
                self.keys.setdefault(word, []).append(name)
        self.key_set = frozenset(self.keys)

    def found(self, text: bytes) -> list[tuple[int, int, str, int, float]]:
        """(start word, end word, notice, matched words, coverage) in a whole text; of notices
        that overlap the one with the most coverage, then words, then the first name."""
        words = words_of(text)
        held = set(words)
        hit = self.key_set & held
        if not hit:
            return []
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in hit:
                for name in self.keys[w]:
                    if self.must[name] <= held:
                        places.setdefault(name, []).append(i)
        seen = []
        for name, at in places.items():
            notice = self.words[name]
            reach = len(notice) + len(notice) // 4 + 2
            regions: list[list[int]] = []
            for i in at:
                if regions and i - reach <= regions[-1][1]:
                    regions[-1][1] = i + reach
                else:
                    regions.append([max(0, i - reach), i + reach])
            for begin, end in regions:
                seen += self._within(words, begin, min(end, len(words)), name, notice)
        seen.sort(key=lambda s: (-s[4], -s[3], s[2], s[0]))
        out: list[tuple[int, int, str, int, float]] = []
        for s in seen:
            if all(s[1] <= o[0] or s[0] >= o[1] for o in out):
                out.append(s)
        return sorted(out)

    def _within(self, words: list[bytes], begin: int, end: int, name: str, notice: list[bytes]) -> list[tuple[int, int, str, int, float]]:
        """The notice's occurrences in a region. One that stands several times has no unique
        words there, so the region is also taken window by window from each likely start."""
        out, at = [], begin
        starts = {notice[0], notice[min(1, len(notice) - 1)], notice[min(2, len(notice) - 1)]}
        spans = [(begin, end)] + [(i, min(end, i + len(notice) + len(notice) // 4)) for i in range(begin, end) if words[i] in starts]
        for b, e in spans:
            if b < at and b != begin:
                continue
            pairs = aligned(words[b:e], notice)
            if not pairs:
                continue
            first, last = b + pairs[0][0], b + pairs[-1][0] + 1
            share = len(pairs) / len(notice)
            if share >= self.job.coverage and len(pairs) >= self.job.density * (last - first) and self._decided(words[first : last + 1], name, notice, [(b + x - first, y) for x, y in pairs]):
                out.append((first, last, name, len(pairs), share))
                at = last
        return out


    def _decided(self, text: list[bytes], name: str, notice: list[bytes], pairs: list[tuple[int, int]]) -> bool:
        """Whether the deciding words of the notice all match and no others stand between. A
        version may be without its last zero, if no other number stands there. ``text`` has
        the word after the match too."""
        deciding, free = self.deciding[name], {b"library"} if b"lesser" in notice else set()
        of_text, of_notice = {x for x, _ in pairs}, {y for _, y in pairs}
        last = pairs[-1][0] + 1
        bare = notice[-1] == b"0" and not NUMBERS.intersection(text[last:])
        return all(i in of_notice or (bare and i == len(notice) - 1) for i, w in enumerate(notice) if w in deciding and w not in free) and all(
            i in of_text for i, w in enumerate(text[:last]) if w in deciding and w not in free
        )


def scan(docs: DataFrame, job: LicenseScan = LicenseScan()) -> DataFrame:
    """doc_id, license, coverage, matched_words, start_word, end_word: one row per notice found.

    Whole texts; no shuffle. Null and empty texts have no notices; a null doc_id is reported
    with its finds; repeated rows give repeated finds, a notice that stands twice gives two.
    Equally good notices at one place: the first name. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = Notices(job)
        for batch in batches:
            rows = [
                (doc_id, name, share, n, first, last)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if text
                for first, last, name, n, share in notices.found(text)
            ]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "license", "coverage", "matched_words", "start_word", "end_word"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, license string, coverage double, matched_words long, start_word long, end_word long"
    )
