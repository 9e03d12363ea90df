"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised to lower-case words of letters and digits, the spelling of licence evened. A template
is compared with runs of words, wherever they stand: within a line, across lines, or as a whole text. If a run reaches the
Dice coefficient t, it shares at least t / (2 - t) of the template's bigrams and has at most (2 - t) / t times as many;
these bounds on sizes prune templates and places. A run that begins or ends with a bigram of no use to it is worse than
the run without, so runs are grown from one bigram of the template to another.

Defined cases: a null or empty text has no licence (null, score 0, line null); of several matches the best score counts,
then the longer template, then the name; lines count from 0; repeated rows are scanned alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexarium.llm import common

#: The least Dice coefficient.
LEAST = 0.8
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Fixed values: (licence, template), the texts and notices of common licences.
TEMPLATES = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{_CLAUSES} {_BSD}"),
    ("BSD-3-Clause", f"{_CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words of letters and digits; licence and licensed are spelt one way."""
    return [w.replace("licenc", "licens") if "licenc" in w else w for w in WORD.findall(text.lower())]


def dice(a: Counter, b: Counter) -> float:
    """Of two bags of bigrams; 0 for two empty ones."""
    size = a.total() + b.total()
    return 2 * (a & b).total() / size if size else 0.0


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> None:
        self.least, self.share = least, least / (2 - least)
        self.names = [name for name, _ in templates]
        self.bags = [Counter(zip(w, w[1:])) for w in (words_of(t) for _, t in templates)]  # noqa: B905
        self.sizes = [b.total() for b in self.bags]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, bag in enumerate(self.bags):
            for pair in bag:
                self.holders.setdefault(pair, []).append(k)

    def scan(self, text: str) -> tuple[str | None, float, int | None]:
        """The best licence of the text, its coefficient and the line where its run begins."""
        words: list[str] = []
        ends: list[int] = []  # words up to each line's end
        for line in text.split("\n"):
            words += words_of(line)
            ends.append(len(words))
        pairs = list(zip(words, words[1:]))  # noqa: B905
        hits: dict[int, list[int]] = {}
        if not self.holders.keys().isdisjoint(pairs):
            for at, pair in enumerate(pairs):
                for k in self.holders.get(pair, ()):
                    hits.setdefault(k, []).append(at)
        best: tuple[float, int, str] | None = None
        place = None
        for k in sorted(hits):
            if len(hits[k]) >= self.share * self.sizes[k] - 1e-9 and (found := self._run(pairs, hits[k], k)):
                own = (found[0], self.sizes[k], self.names[k])
                if best is None or own > best:
                    best, place = own, found[1]
        return (best[2], best[0], bisect_right(ends, place)) if best else (None, 0.0, None)

    def _run(self, pairs: list[tuple[str, str]], at: list[int], k: int) -> tuple[float, int] | None:
        """(coefficient, first word) of the best run that reaches template k, the first of equal ones. at: places of its bigrams."""
        bag, size = self.bags[k], self.sizes[k]
        need, most = self.share * size - 1e-9, size / self.share + 1e-9
        best: tuple[float, int] | None = None
        for i, first in enumerate(at):
            last = bisect_right(at, first + int(most) - 1)
            if last - i < need:
                continue
            seen: Counter[tuple[str, str]] = Counter()
            both = 0
            for j in range(i, last):
                pair = pairs[at[j]]
                seen[pair] += 1
                both += seen[pair] <= bag[pair]
                d = 2 * both / (at[j] - first + 1 + size)
                if d >= self.least and (best is None or d > best[0]):
                    best = (d, first)
        return best


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, licence, score, line of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(templates, least)
        for b in batches:
            found = [own.scan(t) for t in b.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], ["doc_id", "licence", "score", "line"])

    return common.documents(docs).mapInArrow(run, "doc_id long, licence string, score double, line long")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence of each whole text."""
    return scanned(common.table(spark, sf_dir, "documents"))
