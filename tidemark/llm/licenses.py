"""License scans by conditional compression.

Windows around licence cues are compressed alone and with each template, whose fixed words they hold, as a zstandard raw
dictionary. The size reduction ranks these templates; each is confirmed, or not, by the exact differences in wording: every word
of a template's notice must be there in order, apart from a share that its length allows, and none of its fixed words
(names and versions) may be missing. Every confirmed notice counts, but for one whose words mostly belong to a longer one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import batches, bounded_batches, extended

#: Public licence notices, as (identifier, notice, words that must not differ).
NOTICES = (
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "Licensed under the MIT License.", "mit license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "sublicense sell"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public license 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public license 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public license 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions binary"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "distribute fee"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0.", "cc0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
)
_CUE = re.compile(r"licen[cs]|permission|redistribut|free\s+software|public\s+domain|creative\s+commons|copyright|unencumbered")
#: Cost of a missing fixed word: more than any number of others.
FAR = 1 << 20
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Finding:
    license: str
    reduction: float
    exact: bool
    n_differences: int
    differences: str
    at: tuple[int, ...]  # positions of the words met


class Scanner:
    """Templates, with a compressor for each."""

    def __init__(self, notices=NOTICES, level: int = 3, most_missing: float = 0.1):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.templates = []
        for name, notice, fixed in notices:
            as_dict = zstandard.ZstdCompressionDict(notice.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, words(notice), frozenset(words(fixed)), zstandard.ZstdCompressor(level=level, dict_data=as_dict, write_content_size=False, write_dict_id=False)))
        self.most_missing = most_missing
        self.longest = max(len(t[1]) for t in self.templates)

    def blocks(self, text: str) -> Iterator[tuple[str, int]]:
        """Windows of bounded length around the cues, each with the position of its first word. Wherever lines end, a notice
        with a cue is in one of them as a whole."""
        low = text.lower()
        if not _CUE.search(low):
            return
        starts, ends = np.array([m.span() for m in _WORD.finditer(low)]).T
        reach = self.longest + int(self.most_missing * self.longest)
        near: list[list[int]] = []
        for m in _CUE.finditer(low):
            first = max(0, int(np.searchsorted(ends, m.start(), side="right")) - reach)
            last = min(len(starts), int(np.searchsorted(starts, m.end())) + reach)
            if near and first <= near[-1][1]:
                near[-1][1] = last
            else:
                near.append([first, last])
        for first, last in near:
            while True:
                stop = min(first + 4 * reach, last)
                yield low[starts[first] : ends[stop - 1]], first
                if stop == last:
                    break
                first += 3 * reach

    def confirm(self, block: list[str], template: list[str], fixed: frozenset) -> list[tuple[tuple[int, ...], list[str]]]:
        """Every place where the template's wording is in the block, least differences first and none twice: the positions of
        the words met, and what differs, as -missing and +inserted words."""
        most, have = int(self.most_missing * len(template)), {*block}
        if not fixed <= have or sum(w not in have for w in template) > most:
            return []
        codes = {w: i for i, w in enumerate(dict.fromkeys(template))}
        own = np.array([codes.get(w, -1) for w in block])
        costs = [FAR if w in fixed else 1 for w in template]
        steps = np.arange(len(block) + 1)
        least = np.zeros((len(template) + 1, len(block) + 1), np.int64)  # differences of the first i words, ending before word j
        for i, (w, cost) in enumerate(zip(template, costs), 1):
            row = least[i - 1] + cost
            row[1:] = np.where(own == codes[w], np.minimum(row[1:], least[i - 1, :-1]), row[1:])
            least[i] = np.minimum.accumulate(row - steps) + steps
        out: list[tuple[tuple[int, ...], list[str]]] = []
        taken = np.zeros(len(block) + 1, bool)
        ends = np.flatnonzero(least[-1] <= 2 * most)
        for j in ends[np.argsort(least[-1, ends], kind="stable")].tolist():
            if taken[j - 1]:
                continue
            i, at, missing, more = len(template), [], [], []
            while i:
                if j and template[i - 1] == block[j - 1] and least[i, j] == least[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                    at.append(j)
                elif least[i, j] == least[i - 1, j] + costs[i - 1]:
                    i -= 1
                    missing.append(template[i])
                else:
                    j -= 1
                    more.append(block[j])
            if at and len(missing) <= most and len(more) <= most and not taken[at].any():
                taken[at[-1] : at[0] + 1] = True
                out.append((tuple(reversed(at)), [f"-{w}" for w in reversed(missing)] + [f"+{w}" for w in reversed(more)]))
        return out

    def reduction(self, data: bytes, alone: int, i: int) -> float:
        return (alone - len(self.templates[i][3].compress(data))) / alone

    def findings(self, block: str) -> list[Finding]:
        """Every confirmed template of a block, in the order of its size reductions, longer wordings before shorter of the same
        rank. The reduction of a finding is that of its own span."""
        spans = [m.span() for m in _WORD.finditer(block)]
        own = [block[a:b] for a, b in spans]
        shared = [i for i, (_, _, fixed, _) in enumerate(self.templates) if fixed <= {*own}]
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        found = []
        for _, _, i in sorted(((self.reduction(data, alone, i), len(self.templates[i][1]), i) for i in shared), reverse=True):
            name, template, fixed, _ = self.templates[i]
            for at, d in self.confirm(own, template, fixed):
                span = block[spans[at[0]][0] : spans[at[-1]][1]].encode("utf-8", "surrogatepass")
                found.append(Finding(name, self.reduction(span, len(self.plain.compress(span)), i), not d, len(d), " ".join(d), at))
        return found

    def scan(self, block: str) -> Finding | None:
        """The finding of the least differences in a block."""
        return best(distinct(self.findings(block)))


def distinct(found: list[Finding]) -> list[Finding]:
    """Those of which at most half the words belong to a finding of more words (of as many: of fewer differences)."""
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (-len(f.at), f.n_differences, -f.reduction, f.license)):
        if all(2 * len({*f.at} & {*o.at}) <= len(f.at) for o in out):
            out.append(f)
    return out


def best(found: list[Finding]) -> Finding | None:
    return min(found, key=lambda f: (f.n_differences, -f.reduction, f.license), default=None)


@lru_cache(maxsize=4)
def scanner(**options) -> Scanner:
    return Scanner(**options)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per row of df: key, licenses (sorted identifiers), license (of the least differences), reduction, exact,
    n_differences, differences, n_blocks (windows).

    Null and empty texts, and those without a confirmed block, have no licenses and null in the rest. Rows stay where they
    are: no shuffle. options go to Scanner.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(key).schema, "license string, licenses array<string>, reduction double, exact boolean, n_differences int, differences string, n_blocks int")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, kept = scanner(**options), {}
        for x in batches(frames):
            rows = []
            for t in x.column(1).to_pylist():
                blocks = list(by.blocks(t)) if t else []
                found = []
                for b, first in blocks:
                    if b not in kept:
                        if len(kept) > 20_000:
                            kept.clear()
                        kept[b] = by.findings(b)
                    found += [replace(f, at=tuple(first + i for i in f.at)) for f in kept[b]]
                found = distinct(found)
                top = best(found)
                rows.append((top and top.license, sorted({f.license for f in found}), top and top.reduction, top and top.exact, top and top.n_differences, top and top.differences, len(blocks)))
            types = (pa.string(), pa.list_(pa.string()), pa.float64(), pa.bool_(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(v, t) for v, t in zip(zip(*rows), types))], schema.names)

    return df.select(key, text).mapInArrow(run, schema)
