"""License scans: Dice coefficient of word bigrams between passages and license templates.

A text is cut into segments at line breaks and sentence ends. A passage is a run of whole segments; only passages
that begin and end in a segment with a bigram of the template can be the best ones, and the bounds that a Dice value
sets on their size prune the rest. Bigrams are counted, so a repeated phrase counts as often as both sides have it.
Where passages of several templates overlap, only the one with the most shared bigrams net of differing ones stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.registry import query

LEAST_DICE = 0.9
# License notices and texts, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
    "the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.{3}"
)


def _gnu(what: str, name: str, version: str) -> list[str]:
    """The header with and without its last sentence."""
    tail = f" You should have received a copy of the GNU {name} along with this {what}"
    return [_GNU.format(what, name, version, t) for t in (
        "", f"{tail}. If not, see <https://www.gnu.org/licenses/>.",
        f"{tail}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")]


# Further notices and short texts.
FURTHER = {
    "BSD-2-Clause": [_BSD.format("")],
    "BSD-3-Clause": [_BSD.format(_BSD_3)],
    "GPL-1.0": _gnu("program", "General Public License", "1"),
    "GPL-2.0": [*_gnu("program", "General Public License", "2"),
                "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": _gnu("program", "General Public License", "3"),
    "LGPL-2.0": _gnu("library", "Library General Public License", "2"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": [*_gnu("program", "Lesser General Public License", "3"), *_gnu("library", "Lesser General Public License", "3")],
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
_TEXTS = Path(__file__).parent / "license_texts"
#: The section in which the AGPL differs most from the GPL.
_AGPL_13 = (
    "  13. Remote Network Interaction; Use with the GNU General Public License.\n\n  Notwithstanding any other provision of "
    "this License, if you modify the Program, your modified version must prominently offer all users interacting with it "
    "remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
    "Corresponding Source of your version by providing access to the Corresponding Source from a network server at no "
    "charge, through some standard or customary means of facilitating copying of software.  This Corresponding Source "
    "shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is "
    "incorporated pursuant to the following paragraph.\n\n"
)


@lru_cache(1)
def all_templates() -> dict[str, list[str]]:
    """TEMPLATES, FURTHER, the full texts and the identifier line of each license.

    The AGPL's text is made of the GPL's with the other name and section 13; its preamble is not exact.
    """
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, texts in FURTHER.items():
        out.setdefault(name, []).extend(texts)
    full = {f.stem: f.read_text("utf-8") for f in sorted(_TEXTS.glob("*.txt"))}
    at, end = (full["GPL-3.0"].index(x) for x in ("  13. Use with the GNU Affero", "  14. Revised Versions"))
    named = [full["GPL-3.0"][a:z].replace("GNU General Public", "GNU Affero General Public").replace(
        "GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC") for a, z in ((0, at), (end, None))]
    full["AGPL-3.0"] = named[0] + _AGPL_13 + named[1]
    for name, text in full.items():
        out.setdefault(name, []).append(text)
        if " END OF TERMS AND CONDITIONS" in text.upper():
            out[name].append(re.split("(?i)END OF TERMS AND CONDITIONS", text)[0])
    for name, texts in out.items():
        line = f"SPDX-License-Identifier: {name}"
        if line not in texts:
            texts.append(line)
    return out


_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?])\s+")

Bigram = tuple[str, str]


def words_in(text: str) -> list[str]:
    """Normalised words: lower case, without punctuation."""
    return _WORD.findall(text.lower())


class Scanner:
    """Templates as counted bigrams, and which templates a bigram occurs in."""

    def __init__(self, templates: dict[str, list[str]], least_dice: float):
        self.least = least_dice
        self.templates: list[tuple[str, Counter[Bigram], int]] = []
        self.where: dict[Bigram, list[int]] = {}
        for name, texts in templates.items():
            for text in texts:
                words = words_in(text)
                counts = Counter(zip(words, words[1:]))
                if counts:
                    for b in counts:
                        self.where.setdefault(b, []).append(len(self.templates))
                    self.templates.append((name, counts, len(words) - 1))

    def passages(self, text: str | None) -> Iterator[tuple[str, float, int, int, int]]:
        """(license, Dice, first word, end word, net) of each passage that matches a template well enough.

        net: shared bigrams less those that only one side has.
        """
        if not isinstance(text, str):
            return
        words: list[str] = []
        segments: list[tuple[int, int]] = []
        for part in _CUT.split(text):
            found = words_in(part)
            if found:
                segments.append((len(words), len(words) + len(found)))
                words += found
        bigrams = list(zip(words, words[1:]))
        hits: dict[int, list[int]] = {}
        get = self.where.get
        for i, b in enumerate(bigrams):
            for t in get(b) or ():
                hits.setdefault(t, []).append(i)
        for t, places in hits.items():
            name, counts, size = self.templates[t]
            # Dice = 2 * both / (size + passage) and both <= the smaller of the two
            low, high = size * self.least / (2 - self.least), size * (2 - self.least) / self.least
            if len(places) < low:
                continue
            starts = sorted({self._segment(segments, p) for p in places})
            stops = sorted({self._segment(segments, p + 1) for p in places})
            for a in starts:
                first = segments[a][0]
                at = bisect_left(places, first)
                if bisect_left(places, first + high, at) - at < low:
                    continue
                left, both, done = dict(counts), 0, at
                for z in stops[bisect_left(stops, a):]:
                    end = segments[z][1]
                    n = end - first - 1
                    if n > high:
                        break
                    # only places hold bigrams of the template
                    while done < len(places) and places[done] < end - 1:
                        b = bigrams[places[done]]
                        if left[b]:
                            left[b] -= 1
                            both += 1
                        done += 1
                    if n < low:
                        continue
                    dice = 2 * both / (n + size)
                    if dice >= self.least:
                        yield name, dice, first, end, 3 * both - n - size

    def __call__(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, best Dice, first word, end word) for each license found in a text, overlapping or not."""
        return self._best((name, -d, first, end) for name, d, first, end, _ in self.passages(text))

    def apart(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """As a call, but each passage goes to one license: of overlapping ones the one with the largest net stands."""
        held: list[tuple[int, int, str, float]] = []
        for net, d, first, end, name in sorted((-net, -d, first, end, name) for name, d, first, end, net in self.passages(text)):
            if all(end <= f or e <= first for f, e, _, _ in held):
                held.append((first, end, name, d))
        return self._best((name, d, first, end) for first, end, name, d in held)

    @staticmethod
    def _best(found: Iterator[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        best: dict[str, tuple[float, int, int]] = {}
        for name, *at in found:
            best[name] = min(best.get(name, (0.0, 0, 0)), tuple(at))
        return [(name, -d, first, end) for name, (d, first, end) in sorted(best.items())]

    @staticmethod
    def _segment(segments: list[tuple[int, int]], word: int) -> int:
        low, high = 0, len(segments) - 1
        while low < high:
            mid = (low + high) // 2
            if segments[mid][1] <= word:
                low = mid + 1
            else:
                high = mid
        return low


def license_scan(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, least_dice: float = LEAST_DICE
) -> DataFrame:
    """(doc_id, license, dice, first_word, end_word): the best passage of each license found in a document.

    One pass without a shuffle. Templates are those of `all_templates` unless given. Overlapping passages go to one
    license. Of equally good passages the first, then the shorter one counts. Null and empty texts
    and texts of one word have no findings; repeated rows each give theirs; other columns are ignored.
    """
    templates = templates or all_templates()

    def run(frames) -> Iterator[pd.DataFrame]:
        scan = Scanner(templates, least_dice)
        for frame in frames:
            rows = [(d, *f) for d, t in zip(frame["doc_id"], frame["text"]) for f in scan.apart(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "dice", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, license string, dice double, first_word int, end_word int")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
