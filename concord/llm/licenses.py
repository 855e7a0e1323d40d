"""License scan by conditional compression with license texts as zstandard raw dictionaries."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of public licenses and of the notices that refer to them, as (license, wording).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    # whole texts of short licenses
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    # the opening passages of long licenses, which every copy of their whole text has
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."),
    ("LGPL-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it. You can use it too, but we suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any particular case."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
#: Words that a license wording cannot do without, also across line ends and comment marks. Every wording has more of them
#: than the words that may differ, so a copy within tolerance holds at least one: texts, and parts of texts, without
#: any are left alone for nothing but speed.
CUE = re.compile(rb"licen[cs]e|software|copyright|permi(?:ssion|tted)|redistribut|mozilla|public[^0-9a-z]+domain|creative[^0-9a-z]+commons|(?<![0-9a-z])cc(?:[^0-9a-z]*by|0)", re.IGNORECASE)
CUE_WORDS = re.compile(CUE.pattern.decode())
#: Hyphens part words, as lines may end at them.
WORD = re.compile(r"[0-9a-z]+(?:[.'/][0-9a-z]+)*")
LEVEL = 9
#: Differing words allowed, as a share of the template's.
TOLERANCE = 0.05


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@cache
def compressors() -> list[tuple[str, list[str], zstandard.ZstdCompressor, int]]:
    """License, words, compressor with the template as raw dictionary, and the template's gain on itself."""
    out = []
    for name, text in TEMPLATES:
        words = words_of(text)
        raw = " ".join(words).encode()
        prior = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prior.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=prior, write_content_size=False, write_checksum=False)
        out.append((name, words, packer, len(plain().compress(raw)) - len(packer.compress(raw))))
    return out


@cache
def plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


def longest() -> int:
    return max(len(words) for _, words, _, _ in compressors())


def reach() -> int:
    """Words that the longest wording takes at most, with the extra ones that are tolerated."""
    return longest() + int(TOLERANCE * longest())


def windows(text: bytes) -> Iterator[tuple[int, list[str]]]:
    """Stretches of words, with the number of the first, that hold every word within ``reach`` of a cue.

    Lines play no part. Cues within ``reach`` of each other share a stretch; a long one is cut in pieces that overlap by
    ``reach`` words, so a copy of a wording is in one piece as a whole.
    """
    if not CUE.search(text):
        return
    low, far = text.decode("utf-8", "replace").lower(), reach()
    cues = (m.start() for m in CUE_WORDS.finditer(low))
    cue, until, before, block, new = next(cues, None), -1, deque(maxlen=far), [], False
    for i, m in enumerate(WORD.finditer(low)):
        while cue is not None and cue < m.end():
            cue, until = next(cues, None), i + far
        if i <= until:
            if not block:
                block = list(before)
            block.append(m[0])
            new = True
            if len(block) >= 4 * far:
                yield i + 1 - len(block), block
                block, new = block[-far:], False
        elif block:
            if new:
                yield i - len(block), block
            block, new = [], False
        before.append(m[0])
    if new:
        yield i + 1 - len(block), block


def blocks(text: bytes) -> list[list[str]]:
    return [words for _, words in windows(text)]


#: One differing word in the table of ``occurrences``; the bits below hold where the stretch begins.
ONE = 1 << 32


def occurrences(codes: np.ndarray, template: list[int], limit: int) -> list[tuple[int, int, int]]:
    """``(differences, start, end)`` of the stretches of ``codes`` that equal ``template`` up to ``limit`` words.

    Differences are words of the template that the stretch lacks, plus words of the stretch that the template lacks: the
    fewest of any alignment. Of stretches with neighbouring ends the closest counts.
    """
    n = len(codes)
    steps = np.arange(n + 1) * ONE
    table = n - np.arange(n + 1)  # of equally close stretches the shortest
    for code in template:
        here = table + ONE
        np.minimum(here[1:], np.where(codes == code, table[:-1], 1 << 62), out=here[1:])
        table = np.minimum.accumulate(here - steps) + steps
        if table.min() >= (limit + 1) * ONE:
            return []
    ends = np.flatnonzero(table < (limit + 1) * ONE)
    out = []
    for run in np.split(ends, np.flatnonzero(np.diff(ends) > 1) + 1):
        end = run[np.argmin(table[run])]
        out.append((int(table[end] // ONE), int(n - table[end] % ONE), int(end)))
    return out


def possible(block: list[str]) -> list[int]:
    """Templates that lack no more words of the block than may differ, counted without regard to order: a bound that no copy
    within tolerance exceeds."""
    there = Counter(block)
    return [k for k, (_, words, _, _) in enumerate(compressors()) if sum((bags()[k] - there).values()) <= int(TOLERANCE * len(words))]


@cache
def bags() -> list[Counter]:
    return [Counter(words) for _, words, _, _ in compressors()]


def located(block: list[str], candidates: list[int], first: int = 0) -> list[tuple[int, int, int, int]]:
    """``(template, differences, start, end)`` of every copy of a candidate within tolerance."""
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in block], np.int64)
    out = []
    for k in candidates:
        words = compressors()[k][1]
        out += [(k, n, first + lo, first + hi) for n, lo, hi in occurrences(codes, [number.get(w, -1) for w in words], int(TOLERANCE * len(words)))]
    return out


def family(name: str) -> str:
    """Licenses whose wordings differ in few words: all versions of one, and the three GNU ones."""
    return re.sub(r"^[AL]?GPL", "GPL", name).split("-")[0]


def closest(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of copies of one family that overlap the closest stays: fewer differences, then the longer (three clauses, not two)."""
    hits = sorted(set(hits), key=lambda h: (h[2], h[3], h[0]))
    name, words = (lambda h: compressors()[h[0]][0]), (lambda h: len(compressors()[h[0]][1]))
    gone = set()
    for i, g in enumerate(hits):
        for j in range(i + 1, len(hits)):
            h = hits[j]
            if h[2] >= g[3]:
                break
            if family(name(g)) == family(name(h)) and name(g) != name(h):
                a, b = (g[1], -words(g)), (h[1], -words(h))
                gone |= {j} if a < b else {i} if b < a else set()
    return [h for i, h in enumerate(hits) if i not in gone]


def confirmed(block: list[str], candidates: list[int]) -> list[tuple[str, int, int]]:
    """(license, differing words, words) of candidates within tolerance, where no other wording covers them better."""
    return [(compressors()[k][0], n, len(compressors()[k][1])) for k, n, _, _ in closest(located(block, candidates))]


def ranked(block: list[str], candidates: list[int]) -> list[tuple[int, float]]:
    """Candidates by the size reduction that each brings as a dictionary, relative to its reduction of itself."""
    raw = " ".join(block).encode()
    base = len(plain().compress(raw))
    gains = []
    for k in candidates:
        _, _, packer, own = compressors()[k]
        gains.append((k, (base - len(packer.compress(raw))) / max(own, 1)))
    return sorted(gains, key=lambda g: (-g[1], g[0]))


def scan(text: bytes) -> tuple[int, list[dict]]:
    """Number of candidate blocks and the licenses found in them.

    Of the wordings that a block has words enough for, those are confirmed in the order of their reductions, and none is
    left out: a block that repeats parts of a wording elsewhere leaves its dictionary little to reduce.
    """
    count, hits, gains = 0, [], {}
    for first, block in windows(text):
        count += 1
        for k, gain in ranked(block, possible(block)):
            hits += located(block, [k], first)
            gains[k] = max(gain, gains.get(k, gain))
    found: dict[str, dict] = {}
    for k, n, _, _ in closest(hits):
        name, words, _, _ = compressors()[k]
        old = found.get(name)
        if old is None or (n, -len(words)) < (old["differences"], -old["words"]):
            found[name] = {"license": name, "differences": n, "words": len(words), "gain": max(gains[k], old["gain"] if old else gains[k])}
        else:
            old["gain"] = max(old["gain"], gains[k])
    return count, [found[k] for k in sorted(found)]


MATCH = pa.struct([("license", pa.string()), ("differences", pa.int64()), ("words", pa.int64()), ("gain", pa.float64())])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_blocks, matches`` for every row, whole texts.

    Defined cases: null and empty texts have no block; the same license found twice in a text is one match with its
    fewest differences; repeated rows give equal rows; null ids stay null; other columns are ignored; an empty table
    gives an empty result. Memory is bounded by one text and its matches: windows
    are looked at one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], pa.list_(MATCH))], names=["doc_id", "n_blocks", "matches"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_blocks long, matches array<struct<license: string, differences: long, words: long, gain: double>>")


def license_summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_blocks, n_licenses, licenses, gains, differences``: licenses joined by commas in the order of their size
    reductions, the largest first, these reductions in percent of each wording's reduction of itself, and the differing words.
    """
    m = F.sort_array(F.transform("matches", lambda x: F.struct((-x["gain"]).alias("g"), x["license"].alias("license"), x["differences"].alias("differences"))))
    shown = lambda f: F.array_join(F.transform(m, f), ",")
    return license_scan(docs).select(
        "doc_id",
        "n_blocks",
        F.size(m).cast("long").alias("n_licenses"),
        shown(lambda x: x["license"]).alias("licenses"),
        shown(lambda x: F.round(-100 * x["g"]).cast("long").cast("string")).alias("gains"),
        F.aggregate(m, F.lit(0).cast("long"), lambda n, x: n + x["differences"]).alias("differences"),
    )
