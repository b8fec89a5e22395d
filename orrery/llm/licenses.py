"""Licence scan: texts against licence templates by the Dice coefficient of their sets of word bigrams.

Lines, paragraphs and the whole text are the units compared. 2|A&B|/(|A|+|B|) >= t needs sizes within
a factor of t/(2-t), so each unit is compared only with templates of a size that can reach t, and
only if it shares a bigram with some template.

Passages within longer units are found by windows over the words of the whole text, whatever its
lines: for a notice as many words as it has, at each place where one of its bigrams begins or ends a
window; for a wording all lengths that can reach t, from each of its bigrams on. Only texts that hold
t/(2-t) of a template's bigrams within such a length are looked at. As notices differ by a name alone,
a window must also hold more than half of the bigrams that the name makes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, BYTE_VALUES, LOWER, Slice, doc_texts, map_slices, prefix_hash, slices, span_hash, window_hash, words_of

THRESHOLD = 0.8

# Names of licences, by identifier.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["Unlicense"],
}
NOTICES = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This program is licensed under the terms of the {}", "Distributed under the {}", "Licensed under a {}", "This work is licensed under a {}"]

# The wording of licences.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


SPDX = "SPDX-License-Identifier: {}"
#: Names that make a line by themselves; within a line they are a mention.
HEADINGS = {f"{the}{name}" for names in NAMES.values() for name in names for the in ("", "The ")}


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates: full wordings, notices made of each name, identifier lines, names as headings."""
    notices = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    return [*TEXTS.items(), *notices, *((k, SPDX.format(k)) for k in NAMES), *((k, the + name) for k, names in NAMES.items() for name in names for the in ("", "The "))]


#: What each notice is without its name.
FRAMES = {n.format(name): n.format("") for names in NAMES.values() for name in names for n in NOTICES} | {SPDX.format(k): SPDX.format("") for k in NAMES}


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]  # sorted bigram hashes
    any: np.ndarray  # sorted bigram hashes of all templates
    lengths: np.ndarray  # bigrams in order, repeated ones too
    holds: np.ndarray  # templates x any: which has which
    named: np.ndarray  # the same for the bigrams that a notice's name makes; none for wordings
    whole: np.ndarray  # which are compared with whole units only

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Templates:
        texts = [t for _, t in rows] + [FRAMES.get(t, t) for _, t in rows]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["i", "t"])
        runs: list[np.ndarray] = []
        for part in slices([batch], 1):
            pairs, bounds, _ = bigrams(part)
            runs += [pairs[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:])]
        kept = [(name, run, np.unique(run), frame, text in HEADINGS) for (name, text), run, frame in zip(rows, runs, runs[len(rows) :]) if len(run)]
        sets = [x[2] for x in kept]
        every = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        holds = np.array([np.isin(every, x) for x in sets]).reshape(len(sets), len(every))
        named = np.array([h & ~np.isin(every, x[3]) for h, x in zip(holds, kept)]).reshape(holds.shape)
        return Templates([x[0] for x in kept], sets, every, np.array([len(x[1]) for x in kept], np.int64), holds, named, np.array([x[4] for x in kept], bool))


def bigrams(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word with its next one (the last word of all has none), word bounds of documents, word starts."""
    low = LOWER[part.data]
    starts, ends, bounds = words_of(low, part.offsets, ALNUM)
    return window_hash(span_hash(prefix_hash(BYTE_VALUES[0][low]), starts, ends), 2), bounds, starts


def best_templates(unit: np.ndarray, known: Templates, threshold: float) -> list[tuple[float, str]]:
    """(Dice, licence) of the templates that reach threshold, sizes outside the bounds left out unseen."""
    n, out = len(unit), []
    ratio = threshold / (2 - threshold)
    for name, own in zip(known.names, known.sets):
        if n * ratio <= len(own) and len(own) * ratio <= n:
            dice = 2 * len(np.intersect1d(unit, own, assume_unique=True)) / (n + len(own))
            if dice >= threshold:
                out.append((dice, name))
    return out


def _starts(hits: np.ndarray, need: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hits from which, and hits to which, a window of the length can hold need hits."""
    if len(hits) < need:
        return hits[:0], hits[:0]
    near = hits[need - 1 :] - hits[: len(hits) - need + 1] < length
    return hits[: len(near)][near], hits[need - 1 :][near]


def passages(pairs: np.ndarray, at: np.ndarray, place: np.ndarray, known: Templates, wanted: np.ndarray, threshold: float) -> list[tuple[float, str, int, int]]:
    """(Dice, licence, first bigram, behind the last) of the windows of a text that reach threshold; of overlapping ones the best.

    pairs are the text's bigrams, at those of them that are in any of the templates and place their numbers there.
    """
    n, ratio = len(pairs), threshold / (2 - threshold)
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    before = np.full(n, -1, np.int64)  # where the same bigram stood last
    before[order[1:][same]] = order[:-1][same]
    number = np.full(n, known.holds.shape[1], np.int64)
    number[at] = place
    found: list[tuple[float, int, int, int]] = []
    for t in wanted.tolist():
        size, length, name = len(known.sets[t]), int(known.lengths[t]), np.append(known.named[t], False)
        own, notice = np.append(known.holds[t], False), bool(name.any())
        reach = min(length if notice else int(length / ratio + 1e-9), n)
        first, last = _starts(at[known.holds[t][place]], int(np.ceil(size * ratio - 1e-9)), reach)
        if notice:
            first = np.unique(np.clip(np.concatenate([first, last - length + 1]), 0, n - length)) if n >= length else first[:0]
        step = max(1, (1 << 20) // max(1, reach))
        for low in range(0, len(first), step):
            start = first[low : low + step, None]
            window = start + np.arange(reach)
            inside = window < n
            window = np.minimum(window, n - 1)
            new = (before[window] < start) & inside
            hit = new & own[number[window]]
            dice = 2 * hit.cumsum(1) / (new.cumsum(1) + size)
            if notice:
                end = np.full(len(start), reach - 1)
                good = 2 * (new & name[number[window]]).sum(1) > name.sum()
            else:
                end, good = np.where(hit, dice, 0).argmax(1), np.ones(len(start), bool)
            best = dice[np.arange(len(start)), end]
            for k in np.flatnonzero(good & (best >= threshold)).tolist():
                found.append((float(best[k]), t, int(start[k, 0]), int(start[k, 0] + end[k] + 1)))
    taken, out = np.zeros(n + 1, bool), []
    for dice, t, s, e in sorted(found, key=lambda x: (-x[0], -len(known.sets[x[1]]), known.names[x[1]], x[2])):
        if not taken[s:e].any():
            taken[s:e] = True
            out.append((dice, known.names[t], s, e))
    return out


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license (best match or null), dice (of it, else 0), n_units (units that match, and passages outside of them), licenses (all matched, sorted).

    Ties go to the first name in order. A null, empty or one-word text has no bigram and no match.
    Repeated rows give equal rows; ids may be null.
    """
    sent = df.sparkSession.sparkContext.broadcast(Templates.of(rows or templates()))  # a fixed list

    def work(part: Slice) -> dict:
        known = sent.value
        pairs, bounds, starts = bigrams(part)
        n = len(part)
        found: list[list[tuple[float, str]]] = [[] for _ in range(n)]
        units = np.zeros(n, np.int64)
        place = np.minimum(np.searchsorted(known.any, pairs), len(known.any) - 1)
        at = np.flatnonzero(known.any[place] == pairs)
        at = at[np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + 1, "right")]
        if len(at):
            breaks = np.flatnonzero(part.data == 10)
            line = np.searchsorted(breaks, starts)
            blank = np.zeros(len(breaks) + 1, np.int64)
            if len(breaks) > 1:
                blank[1:] = np.cumsum(np.r_[False, ~np.isin(np.arange(1, len(breaks)), np.unique(line))])
            paragraph = blank[line]
            owner = np.searchsorted(bounds, at, "right") - 1
            kinds = np.unique(owner * len(known.any) + place[at])
            docs, which = np.unique(kinds // len(known.any), return_inverse=True)
            has = np.zeros((len(docs), len(known.any)), np.float32)
            has[which, kinds % len(known.any)] = 1
            sizes = known.holds.sum(1)
            possible = has @ known.holds.T.astype(np.float32) >= sizes * (threshold / (2 - threshold)) - 1e-3
            possible[:, known.whole] = False
            for row, d in enumerate(docs.tolist()):
                a, b = int(bounds[d]), int(bounds[d + 1])
                own = at[np.searchsorted(at, a) : np.searchsorted(at, b)]
                spans = {(a, b)}
                for group in (line, paragraph):
                    for g in np.unique(group[own]).tolist():
                        spans.add((max(a, int(np.searchsorted(group, g))), min(b, int(np.searchsorted(group, g, "right")))))
                matched = []
                for s, e in sorted(spans):
                    hits = best_templates(np.unique(pairs[s : max(s, e - 1)]), known, threshold)
                    matched += [(s, e)] * bool(hits)
                    found[d] += hits
                units[d] = len(matched)
                if possible[row].any():
                    for dice, name, s, e in passages(pairs[a : b - 1], own - a, place[own], known, np.flatnonzero(possible[row]), threshold):
                        found[d].append((dice, name))
                        units[d] += not any(x < a + e + 1 and a + s < y for x, y in matched)
        best = [min(((-x, k) for x, k in f), default=(0.0, None)) for f in found]
        return {
            "doc_id": part.batch.column(0), "license": pa.array([k for _, k in best], pa.string()), "dice": pa.array([abs(x) for x, _ in best], pa.float64()),
            "n_units": units, "licenses": pa.array([sorted({k for _, k in f}) for f in found], pa.list_(pa.string())),
        }

    return map_slices(doc_texts(df, id_col, text_col), "doc_id long, license string, dice double, n_units long, licenses array<string>", work)
