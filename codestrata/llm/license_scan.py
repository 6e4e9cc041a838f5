"""License scan by conditional compression.

Candidate blocks are cut from texts that mention a license at all: each
sentence with a license word (by lines, and with wrapped lines joined), the words
around a license word that no sentence settled, and each stretch of text in which such sentences
follow one another closely.  A block is compressed by zstandard alone and with
each template as a raw dictionary (but for those of whose words it has too few for
them to be confirmed at all); the share of the size that the template
saves ranks the templates.  Templates are then compared word by word with the
block, best first, and the one with the fewest differences is confirmed if it
differs in at most ``tolerance`` of its words: template words that are missing,
and block words inside the matched stretch that the template does not have.  All
templates that save anything are compared; ``ranked`` stops sooner.

Short templates (notices) are matched against sentences, long ones (license
texts) against stretches, taken in overlapping windows so that a long stretch
costs linear time.  A short
notice that matches no template is judged by the words that name the license after
a cue ("under", "License:", an SPDX tag) or alone on a title line: the wordings ``NAMES`` are
templates too, ranked by what they save, and the winner's words must all be there in
order; the words that introduce them are free.  What lies before and
after a match is judged again, so a block gives a row for every license in it.
A finding that overlaps a longer one is left out.

The words that make a text a candidate are ``HINTS`` (their words in a row, whatever
stands between them) and, for a template of which a confirmed copy can lack all of these,
as many pairs of its words as it cannot all break (``hints_for``).

Cases: null and empty texts give no row; a text of any length is scanned whole,
block by block; repeated rows, ids and notices each give a row; ties go to the
better reduction, then the first name; an empty table gives an empty result;
columns other than the key and text are not carried, so none can clash.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import accumulate
from operator import and_, or_

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, text_slices, texts

LEVEL = 19
#: Around blocks and templates, as zstandard looks for no match in a block's last bytes.
_PAD = b"\n" * 8
LONG_WORDS = 40

# The wording of public licenses and their usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache 2.0 license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")."),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Proprietary", "All rights reserved."),
)
# Words that name a license, after "under" and whatever of _FREE stands before them.
_VERSIONED = (
    ("LGPL-3.0", ("gnu lesser general public license", "gnu lgpl", "lgpl"), "3"), ("AGPL-3.0", ("gnu affero general public license", "gnu agpl", "agpl"), "3"),
    ("GPL-3.0", ("gnu general public license", "gnu gpl", "gpl"), "3"), ("GPL-2.0", ("gnu general public license", "gnu gpl", "gpl"), "2"),
    ("MPL-2.0", ("mozilla public license", "mpl"), "2"), ("Apache-2.0", ("apache license", "apache software license", "apache"), "2"),
)
_FORMS = ("{0} version {1} 0", "{0} version {1}", "{0} v {1} 0", "{0} v {1}", "{0} v{1} 0", "{0} v{1}", "{0}v{1} 0", "{0}v{1}", "{0} {1} 0", "{0} {1}", "version {1} 0 of the {0}", "version {1} of the {0}", "v{1} 0 of the {0}", "v{1} of the {0}")
NAMES: tuple[tuple[str, str], ...] = (
    *((name, form.format(called, n)) for name, all_called, n in _VERSIONED for called in all_called for form in _FORMS),
    *((name[:-4], called) for name, all_called, _ in _VERSIONED for called in all_called if called != "apache"), ("BSD", "bsd"),
    ("MIT", "mit"), ("MIT", "expat"), ("ISC", "isc"), ("Unlicense", "unlicense"), ("CC0-1.0", "cc0 1 0"), ("CC0-1.0", "cc0"),
    *((f"BSD-{n}-Clause", form.format(n)) for n in "23" for form in ("bsd {0} clause", "{0} clause bsd")),
    *((name, form + " 4 0") for name, low, long in (
        ("CC-BY-4.0", "by", "attribution"), ("CC-BY-SA-4.0", "by sa", "attribution sharealike"), ("CC-BY-NC-4.0", "by nc", "attribution noncommercial"),
        ("CC-BY-NC-SA-4.0", "by nc sa", "attribution noncommercial sharealike"), ("CC-BY-ND-4.0", "by nd", "attribution noderivatives"),
    ) for form in (f"cc {low}", f"creative commons {long}")),
)
_VERBS = {"licensed", "licenced", "released", "distributed", "published", "available", "provided", "redistributed", "covered", "offered", "shared", "made", "code", "is"}
_FREE = {"the", "a", "an", "terms", "and", "conditions", "of", "or", "either", "both", "license", "licence", "licenses", "your", "choice", "at", "option", "international", "permissive", "standard", "open", "source"}
#: Blanks and marks before a title, and half of what may follow it on its line.
_TITLE_CHARS = 60
#: What may stand on a title line beside the name: "MIT License (MIT)", "Version 3, 29 June 2007".
_TITLE = re.compile(r"\W*(?:(?:licen[sc]e|version|v?\d[\d.]*|mit|isc|the|january|february|march|april|may|june|july|august|september|october|november|december)\b\W*)*", re.IGNORECASE)
#: A text without any of these (lower-cased) holds no candidate.
HINTS = ("licens", "licenc", "copyright", "permission is hereby", "permission to use", "redistribution", "public domain", "rights reserved", "warrant", "mozilla public", "creative commons", "released under", "distributed under", "published under", "available under", "provided under")
#: Judged blocks that a worker remembers, by digest, within a task.
MEMO = 50_000
_LICENSE = {"license", "licence", "licenses", "licences"}
_SENTENCE_END = re.compile(r"[.!?](?=\s)|\n+")
#: As before, but a wrapped line goes on up to a blank one (comment marks alone leave a line blank).
_WRAPPED_END = re.compile(r"[.!?](?=\s)|\n(?:[^\w\n]*\n)+")
_WORD = re.compile(r"[^\W_]+")

FINDING = T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("reduction", T.DoubleType()),
    T.StructField("n_missing", T.IntegerType()), T.StructField("n_extra", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
])


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    reduction: float
    missing: int
    extra: int
    words: int


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        self.count = Counter(self.words)
        plain = _PAD + " ".join(self.words).encode() + _PAD
        self.dictionary = zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.dictionary.precompute_compress(level=LEVEL)
        self.codec = _codec(self.dictionary)

    def reduction(self, plain: bytes, alone: int) -> float:
        """Share of the compressed size that the template saves."""
        return 1 - len(self.codec.compress(plain)) / alone

    def possible(self, block: Counter, slack: int) -> bool:
        """Whether at most ``slack`` of the template's words can be missing."""
        return sum(min(n, block[w]) for w, n in self.count.items()) >= len(self.words) - slack

    def differences(self, block: list[str], slack: int) -> tuple[int, int, int, int]:
        """(missing, extra, first, last) words of the best alignment around the
        longest run of equal words, as another copy of the text may follow."""
        matcher = difflib.SequenceMatcher(None, self.words, block, autojunk=False)
        top = matcher.find_longest_match()
        if not top.size:
            return len(self.words), 0, 0, 0
        lo = max(0, top.b - top.a - slack)
        own = block[lo : top.b - top.a + len(self.words) + slack]
        if len(own) < len(block):
            matcher.set_seq2(own)
        matched = [m for m in matcher.get_matching_blocks() if m.size]
        same, first, last = sum(m.size for m in matched), matched[0].b, matched[-1].b + matched[-1].size
        return len(self.words) - same, last - first - same, lo + first, lo + last


def _codec(dictionary=None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


def hints_for(templates: tuple[tuple[str, str], ...], tolerance: float) -> tuple[str, ...]:
    """HINTS, and pairs of words (single ones where no pair is left) of every template
    that has too few of them: a difference breaks one hint at most, so with one hint more
    than a confirmed copy has differences, one is whole."""
    single = [h for h in HINTS if " " not in h]
    rows = dict.fromkeys(tuple(h.split()) for h in HINTS if " " in h)
    for _, text in templates:
        own = words(text)
        free = [not any(h in w for h in single) for w in own]
        need = int(tolerance * len(own)) + 1 - free.count(False)

        def take(row: tuple[str, ...], at: int) -> bool:
            hit = tuple(own[at : at + len(row)]) == row and all(free[at : at + len(row)])
            if hit:
                free[at : at + len(row)] = [False] * len(row)
            return hit

        need -= sum(take(row, at) for row in rows for at in range(len(own)))
        for size in (2, 1):
            for row, at in sorted(((tuple(own[i : i + size]), i) for i in range(len(own) - size + 1)), key=lambda x: (-len("".join(x[0])), x)):
                if need > 0 and take(row, at):
                    rows[row] = None
                    need -= 1
    return (*single, *map(" ".join, rows))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], ranked: int | None, tolerance: float):
        made = [Template(*t) for t in templates]
        self.short = [t for t in made if len(t.words) < LONG_WORDS]
        self.long = [t for t in made if len(t.words) >= LONG_WORDS]
        self.window = 2 * max([LONG_WORDS, *(len(t.words) for t in self.long)])
        self.alone, self.ranked, self.tolerance = _codec(), ranked, tolerance
        self.hint = re.compile("|".join(r"[\W_]+".join(map(re.escape, h.split())) for h in hints_for(templates, tolerance)), re.IGNORECASE)
        self.named: dict[str, list[Template]] = {}
        for name, text in NAMES:
            self.named.setdefault(text.split()[0], []).append(Template(name, text))
        self.memo: dict[bytes, tuple | None] = {}

    def judge(self, block: tuple[str, ...], long: bool):
        key = hashlib.blake2b(b"%d" % long + " ".join(block).encode("utf-8", "replace"), digest_size=16).digest()
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = self._judge(block, long)
        return self.memo[key]

    def _judge(self, block: tuple[str, ...], long: bool):
        """(license, reduction, missing, extra, first word, last word) or None."""
        if not block:
            return None
        count, best = Counter(block), None
        able = [t for t in (self.long if long else self.short) if t.possible(count, int(self.tolerance * len(t.words)))]
        if not able:
            return None
        plain = _PAD + " ".join(block).encode("utf-8", "replace") + _PAD
        alone = len(self.alone.compress(plain))
        ranks = sorted(((-t.reduction(plain, alone), t.name, i) for i, t in enumerate(able)))
        for minus, name, i in ranks[: self.ranked]:
            t = able[i]
            slack = int(self.tolerance * len(t.words))
            if minus >= 0:
                continue
            missing, extra, first, last = t.differences(list(block), slack)
            if missing + extra <= self.tolerance * len(t.words):
                found = ((missing + extra) / len(t.words), -len(t.words), minus, name, missing, extra, first, last)
                best = found if best is None or found < best else best
        return best and (best[3], -best[2], *best[4:])

    def _spans(self, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        return [(m.start() + lo, m.end() + lo) for m in _WORD.finditer(text[lo:hi].lower())] if len(text[lo:hi].lower()) == hi - lo else [m.span() for m in _WORD.finditer(text, lo, hi)]

    def _try(self, text: str, spans: list[tuple[int, int]], long: bool, found: list[Finding]) -> None:
        left = [spans]  # what lies before and after a finding is judged again
        while left:
            spans = left.pop()
            if not spans or long and len(spans) < LONG_WORDS // 2:
                continue
            hit = self.judge(tuple(text[a:b].lower() for a, b in spans), long)
            if not hit:
                if not long:
                    self._named(text, spans, found)
                continue
            name, reduction, missing, extra, first, last = hit
            found.append(Finding(name, spans[first][0], spans[last - 1][1], reduction, missing, extra, last - first))
            left += [spans[:first], spans[last:]]

    def _named(self, text: str, spans: list[tuple[int, int]], found: list[Finding]) -> None:
        """Licenses named after a cue, whatever words introduce them, or by a title line."""
        block = [text[a:b].lower() for a, b in spans]
        k = 0
        while k < len(block):
            first, end = k, k
            if block[k] == "under":
                first = next((v for v in range(k - 1, max(-1, k - 4), -1) if block[v] in _VERBS), None)
                end = k + 1
            elif block[k] in _LICENSE and k + 1 < len(block) and re.search("[:=]", text[spans[k][1] : spans[k + 1][0]]):
                end = k + 1
            elif block[k] == "identifier" and block[max(0, k - 2) : k] == ["spdx", "license"]:
                first, end = k - 2, k + 1
            if first is not None and end > k:
                k = max(k, self._listed(text, spans, block, first, end, found) - 1)
            elif first is not None and block[k] in self.named and self._starts_line(text, spans[k][0]):
                k = max(k, self._title(text, spans, block, k, found) - 1)
            k += 1

    @staticmethod
    def _starts_line(text: str, at: int) -> bool:
        before = text[max(0, at - _TITLE_CHARS) : at].rpartition("\n")
        return (bool(before[1]) or at < _TITLE_CHARS) and words(before[2]) in ([], ["the"])

    def _listed(self, text, spans, block, first: int, at: int, found: list[Finding]) -> int:
        """Every license named from word ``at`` on, free words between them; the word after the last."""
        last = at
        while at < len(block):
            hit = self._winner(block, first, at)
            if hit:
                t, saved, end = hit
                end += block[end : end + 1] in (["license"], ["licence"])
                found.append(Finding(t.name, spans[first][0], spans[end - 1][1], saved, 0, 0, end - first))
                at = first = last = end
            elif block[at] in _FREE:
                at += 1
            else:
                break
        return last

    def _title(self, text, spans, block, at: int, found: list[Finding]) -> int:
        """A license that fills a line: its name with the word license, and little besides."""
        hit = self._winner(block, at, at)
        if not hit:
            return at
        t, saved, end = hit
        end += block[end : end + 1] in (["license"], ["licence"])
        rest = text[spans[end - 1][1] : spans[end - 1][1] + 2 * _TITLE_CHARS].partition("\n")
        if not _LICENSE & set(block[at:end]) or len(rest[0]) == 2 * _TITLE_CHARS or not _TITLE.fullmatch(rest[0]):
            return at
        found.append(Finding(t.name, spans[at][0], spans[end - 1][1], saved, 0, 0, end - at))
        return end

    def _winner(self, block: list[str], first: int, at: int) -> tuple[Template, float, int] | None:
        """The wording at word ``at`` that saves most of the words from ``first`` to the
        end of the longest one, what it saves, and the word after it."""
        able = [t for t in self.named.get(block[at], ()) if block[at : at + len(t.words)] == t.words]
        if not able:
            return None
        plain = _PAD + " ".join(block[first : at + max(len(t.words) for t in able)]).encode("utf-8", "replace") + _PAD
        alone = len(self.alone.compress(plain))
        saved, _, name, i = min((-t.reduction(plain, alone), -len(t.words), t.name, i) for i, t in enumerate(able))
        return (able[i], -saved, at + len(able[i].words)) if saved < 0 else None

    def _sentences(self, text: str, marks: list[int], end: re.Pattern) -> tuple[list[int], list[int]]:
        """(cuts of the text, the sentences with a mark)."""
        cuts = [0, *(m.end() for m in end.finditer(text)), len(text)]
        sentences, at = [], 0
        for mark in marks:
            while cuts[at + 1] <= mark and at + 2 < len(cuts):
                at += 1
            if not sentences or sentences[-1] != at:
                sentences.append(at)
        return cuts, sentences

    @staticmethod
    def _marked(spans: list[tuple[int, int]], marks: list[int]) -> list[int]:
        """Numbers of the words that hold a mark."""
        starts = [a for a, _ in spans]
        inside = marks[bisect_left(marks, spans[0][0]) : bisect_left(marks, spans[-1][1])] if spans else []
        return list(dict.fromkeys(bisect_right(starts, m) - 1 for m in inside))

    def _try_across(self, text: str, cuts: list[int], group: list[int], marks: list[int], near: int, found: list[Finding]) -> None:
        """Short notices that run over the end of a sentence, around marks that no finding holds."""
        lo, hi = cuts[max(0, group[0] - 4)], cuts[min(group[-1] + 5, len(cuts) - 1)]
        spans = self._spans(text, lo, hi)
        taken = sorted((f.start, f.end) for f in found if f.start < hi and lo < f.end)
        starts = [a for a, _ in taken]
        ends = list(accumulate((b for _, b in taken), max))
        open_marks = []
        for k in self._marked(spans, marks):
            before = bisect_right(starts, spans[k][0])
            if not before or ends[before - 1] <= spans[k][0]:
                open_marks.append(k)
        for lo, hi in self._windows(open_marks, near):
            if self.judge(tuple(text[a:b].lower() for a, b in spans[lo:hi]), False):
                self._try(text, spans[lo:hi], False, found)

    @staticmethod
    def _windows(marked: list[int], near: int):
        """Ranges of words: each marked one with ``near`` words on both sides lies in one,
        and close ones share it, so many marks cost linear time."""
        at = 0
        while at < len(marked):
            last = bisect_right(marked, marked[at] + 2 * near) - 1
            yield max(0, marked[at] - near), marked[last] + near
            at = last + 1

    def scan(self, text: str) -> list[Finding]:
        marks = [m.start() for m in self.hint.finditer(text)]
        if not marks:
            return []
        cuts, sentences = self._sentences(text, marks, _SENTENCE_END)
        wrapped, joined = self._sentences(text, marks, _WRAPPED_END)
        pieces = dict.fromkeys([*((cuts[i], cuts[i + 1]) for i in sentences), *((wrapped[i], wrapped[i + 1]) for i in joined)])
        found: list[Finding] = []
        near = max((len(t.words) for t in self.short), default=0) + 2
        for lo, hi in pieces:  # a sentence with all that surrounds a short notice in it
            spans = self._spans(text, lo, hi)
            if len(spans) <= near:
                self._try(text, spans, False, found)
            for lo, hi in self._windows(self._marked(spans, marks), near) if len(spans) > near else ():
                self._try(text, spans[lo:hi], False, found)
        group: list[int] = []
        for i in [*sentences, None]:
            if group and (i is None or i - group[-1] > 4):
                spans = self._spans(text, cuts[group[0]], cuts[min(group[-1] + 3, len(cuts) - 1)])
                if self.long and len(spans) >= LONG_WORDS // 2:
                    for lo in range(0, max(1, len(spans) - self.window // 2), self.window // 2):
                        self._try(text, spans[lo : lo + self.window], True, found)
                self._try_across(text, cuts, group, marks, near, found)
                group = []
            if i is not None:
                group.append(i)
        found = sorted(set(found), key=lambda f: (f.start - f.end, f.start, f.license))
        starts: list[int] = []
        kept: list[Finding] = []  # by start; none overlaps another
        for f in found:
            at = bisect_left(starts, f.start)
            if (at and kept[at - 1].end > f.start) or (at < len(kept) and starts[at] < f.end):
                continue
            starts.insert(at, f.start)
            kept.insert(at, f)
        return kept


@lru_cache(4)
def scanner(templates: tuple[tuple[str, str], ...], ranked: int | None, tolerance: float) -> Scanner:
    return Scanner(templates, ranked, tolerance)


def mentions(text: Column, hints: tuple[str, ...] = HINTS) -> Column:
    """Whether a text (lower-cased once) holds all words of a hint, wherever they stand; the longest is looked for first."""
    by: dict[str, list[list[str]]] = {}
    for h in hints:
        *rest, longest = sorted(h.split(), key=len)
        by.setdefault(longest, []).append(rest)

    def hit(low: Column) -> Column:
        every = []
        for longest, rests in by.items():
            others = [reduce(and_, map(low.contains, rest)) for rest in rests if rest]
            every.append(low.contains(longest) & reduce(or_, others) if len(others) == len(rests) else low.contains(longest))
        return reduce(or_, every)

    return F.exists(F.array(F.lower(text)), hit)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, ranked: int | None = None, tolerance: float = 0.15) -> DataFrame:
    """A row for each license found: key, license, start_char, end_char,
    reduction, n_missing, n_extra (differing words) and n_words."""
    rows = docs.where(mentions(F.col(text), hints_for(templates, tolerance))).select(key, text)

    def run(batches):
        own = scanner(templates, ranked, tolerance)
        own.memo.clear()
        for batch in batches:
            for part in text_slices(batch, text):
                at, found = [], []
                for i, body in enumerate(texts(part.column(text))):
                    new = own.scan(body.decode("utf-8", "replace"))
                    found += new
                    at += [i] * len(new)
                columns = [[f.license for f in found], [f.start for f in found], [f.end for f in found], [f.reduction for f in found], [f.missing for f in found], [f.extra for f in found], [f.words for f in found]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], [key, *FINDING.names])

    return map_arrow(rows, run, T.StructType([rows.schema[key], *FINDING.fields]))
