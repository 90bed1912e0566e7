"""License notices by conditional compression.

Candidates are cues (licence words, and pieces of every template's own wording: a template whose
tolerance allows e changed words is cut into e + 1 pieces, so a notice that can be confirmed holds
one of them unchanged). Around every cue a block of words is compressed twice, on its own and with a template
as raw zstandard dictionary. What the dictionary saves measures how much of the template's
wording the block holds. Templates are compared word by word in the order of their savings: the
span that one covers, the words that it misses and the words that stand in between decide whether
the notice is confirmed. Savings propose, exact wording decides.

Only texts with a cue leave the JVM; nothing is shuffled and every row is handled by itself.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import hidden_id, shown_id

LEVEL = 19
TOLERANCE = 0.1

# Customary wording of licence notices.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License."),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."),
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-licensed": "Licensed under the MIT License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at"),
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
    '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES')
TEMPLATES |= {"BSD-2-Clause-text": _BSD.format(""), "BSD-3-Clause-text": _BSD.format(
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission. ")}
# The notice that the GNU licences ask for differs in the work, the licence and the version.
TEMPLATES |= {f"{short}-{version}-header": (
    f"This {work} is free software: you can redistribute it and/or modify it under the terms of "
    f"the GNU {kind}General Public License as published by the Free Software Foundation, either "
    f"version {version.removesuffix('.0')} of the License, or (at your option) any later version.")
    for short, kind, work, version in (
        ("GPL", "", "program", "2.0"), ("GPL", "", "program", "3.0"),
        ("LGPL", "Lesser ", "library", "2.1"), ("LGPL", "Lesser ", "library", "3.0"),
        ("AGPL", "Affero ", "program", "3.0"))}
_SPDX = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC", "MIT", "MPL-2.0",
         "Unlicense", *(f"{name}-{end}" for name in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1",
                                                     "LGPL-3.0") for end in ("only", "or-later")))
TEMPLATES |= {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in _SPDX}
CUES = r"licen[sc]|public domain|cc by|cc0|permission is hereby"

WORD = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>*#/-"
NUMBERED = re.compile(r"\d")


class Notice(NamedTuple):
    start: int
    length: int
    license_id: str
    plain_bytes: int
    given_bytes: int
    missing: str
    extra: str
    confirmed: bool


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def template_words(text: str) -> list[str]:
    return [w for w in map(bare, text.split()) if w]


def allowed(words: list[str], tolerance: float) -> int:
    return int(tolerance * len(words))


def wording(templates: dict[str, str], tolerance: float) -> str | None:
    """A pattern for places where a piece of a template starts; None without any words.

    ``e`` missing or added words can break at most ``e`` of ``e + 1`` pieces, so every notice that
    is confirmed has such a place. For Python and Java: white space is spelt out as Python has it.
    """
    gap = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + "".join(
        f"\\{c}" for c in EDGES)
    tails: dict[str, set[str]] = {}
    for text in templates.values():
        words = template_words(text)
        parts = min(allowed(words, tolerance) + 1, len(words))
        cuts = [len(words) * k // parts for k in range(parts + 1)] if parts else []
        for a, b in zip(cuts, cuts[1:]):
            piece = f"[{gap}]+".join(map(re.escape, words[a:b]))
            tails.setdefault(words[a][0], set()).add(piece)
    if not tails:
        return None
    # By first letter, so that most words are passed over after one comparison.
    choice = "|".join(f"(?={re.escape(c)})(?:{'|'.join(sorted(t))})" for c, t in sorted(tails.items()))
    return f"(?<![^{gap}])(?:{choice})(?![^{gap}])"


class Scanner:
    """Templates as dictionaries; build once per task."""

    def __init__(self, templates: dict[str, str], tolerance: float = TOLERANCE):
        self.tolerance = tolerance
        self.cue = re.compile(CUES, re.I)
        pieces = wording(templates, tolerance)
        self.piece = re.compile(f"(?={pieces})" if pieces else r"(?!)", re.I)
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = {}
        for name, text in sorted(templates.items()):
            raw = text.encode()
            given = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = template_words(text)
            self.templates[name] = (words, zstandard.ZstdCompressor(level=LEVEL, dict_data=given))
        self.saving = lru_cache(4096)(self._saving)

    def _saving(self, name: str, block: str) -> tuple[int, int]:
        raw = block.encode("utf-8", "surrogatepass")
        return (len(self.plain.compress(raw)), len(self.templates[name][1].compress(raw)))

    def _compare(self, words: list[str], name: str) -> tuple[int, int, list[str], list[str]]:
        """First and last matched word, template words not found, words found in between."""
        wanted = self.templates[name][0]
        match = SequenceMatcher(None, wanted, words, autojunk=False)
        runs = [m for m in match.get_matching_blocks() if m.size]
        if not runs:
            return 0, -1, wanted, []
        first, last = runs[0].b, runs[-1].b + runs[-1].size - 1
        hit_a = {i for m in runs for i in range(m.a, m.a + m.size)}
        hit_b = {i for m in runs for i in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(wanted) if i not in hit_a]
        extra = [words[i] for i in range(first, last + 1) if i not in hit_b]
        return first, last, missing, extra

    def _tolerated(self, name: str, missing: list[str], extra: list[str]) -> bool:
        # A changed number is another licence, however long the text around it.
        if any(NUMBERED.search(w) for w in missing + extra):
            return False
        return len(missing) + len(extra) <= allowed(self.templates[name][0], self.tolerance)

    def notices(self, text: str | None) -> list[Notice]:
        """Best template at every cue, without overlaps, in order of position."""
        if not text:
            return []
        cues = {m.start() for m in self.cue.finditer(text)}
        places = sorted(cues.union(m.start() for m in self.piece.finditer(text)))
        if not places:
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(text) if bare(m.group())]
        starts = [a for a, _ in spans]
        found: list[tuple] = []
        covered = -1
        for place in places:
            at = bisect.bisect_right(starts, place) - 1
            if at <= covered:
                continue
            ranked = []
            for name, (wanted, _) in self.templates.items():
                reach = len(wanted) + allowed(wanted, self.tolerance)
                low, high = max(0, at - reach), min(len(spans), at + reach + 1)
                block = " ".join(text[a:b] for a, b in spans[low:high])
                plain, given = self.saving(name, block)
                ranked.append((given - plain, name, plain, given, low, high))
            ranked.sort()
            # Down the ranking, the first template whose wording is there, at the cue, wins.
            best = None
            for saved, name, plain, given, low, high in ranked:
                words = [bare(text[a:b]) for a, b in spans[low:high]]
                first, last, missing, extra = self._compare(words, name)
                edge = (low + first, low + last) if last >= first else (at, at)
                sure = edge[0] <= at <= edge[1] and self._tolerated(name, missing, extra)
                if sure or best is None:
                    best = (name, plain, given, edge, missing, extra, sure)
                if sure or saved >= 0:
                    break
            name, plain, given, (first, last), missing, extra, sure = best
            if sure:
                covered = last
            elif place not in cues:
                continue
            start, end = spans[first][0], spans[last][1]
            found.append(Notice(start, end - start, name, plain, given, " ".join(missing),
                                " ".join(extra), sure))
        sure = [n for n in found if n.confirmed]
        begins = [n.start for n in sure]
        loose, end = [], -1
        for n in found:
            # Confirmed notices don't overlap, so the last that begins before this one ends decides.
            near = bisect.bisect_left(begins, n.start + n.length) - 1
            apart = near < 0 or sure[near].start + sure[near].length <= n.start
            if not n.confirmed and apart and n.start >= end:
                loose.append(n)
                end = n.start + n.length
        return sorted(sure + loose)


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """One row per notice: doc_id, start and length (code points), license_id, plain_bytes,
    given_bytes, saved, missing, extra, confirmed.

    ``confirmed`` is true when missing and extra words are at most ``tolerance`` of the
    template's words and none of them holds a digit. Other cues keep their best template as an
    unconfirmed row; places found by a template's wording alone give a row if confirmed. Null and
    empty texts and texts without a cue give no row, an empty table none. Texts of any length are
    read whole; of equal savings the first name wins. Ids may be null or repeat; every row of
    ``docs`` gives its own notices. Other columns, whatever their names, are ignored.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    pieces = wording(chosen, tolerance)
    cues = f"(?iu)(?:{CUES}{f'|{pieces}' if pieces else ''})"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(chosen, tolerance)
        for b in batches:
            rows = [(key, *n[:5], n.plain_bytes - n.given_bytes, *n[5:])
                    for key, text in zip(b["doc_id"], b["text"]) for n in scan.notices(text)]
            yield pd.DataFrame(rows, columns=[
                "doc_id", "start", "length", "license_id", "plain_bytes", "given_bytes", "saved",
                "missing", "extra", "confirmed"])

    return docs.select(shown_id("doc_id"), "text").where(
        F.col("text").rlike(cues)).mapInPandas(
        run, "doc_id bigint, start bigint, length bigint, license_id string, plain_bytes bigint, "
             "given_bytes bigint, saved bigint, missing string, extra string, confirmed boolean"
    ).withColumn("doc_id", hidden_id("doc_id"))
