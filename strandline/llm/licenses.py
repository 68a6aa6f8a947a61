"""License scans by conditional compression: a block that a template's text explains compresses away."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Both clauses that the BSD licenses share, and what follows them where there is no third.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
# The wording of public licenses and of the lines that refer to them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", f"{_BSD} {_AS_IS}"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
# One-line references: how they begin, and what they call the license.
_VERBS = ("Licensed", "Released", "Distributed", "Available")
_CALLED = {
    "Apache-2.0": ["the Apache License, Version 2.0.", "the Apache License 2.0."], "MIT": ["the MIT License."], "ISC": ["the ISC License."],
    "GPL-3.0": ["the GNU General Public License, version 3.", "the GNU General Public License v3.0."], "GPL-2.0": ["the GNU General Public License, version 2.", "the GNU General Public License v2.0."],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0.", "a Creative Commons Attribution-NonCommercial 4.0 International License."], "CC-BY-4.0": ["CC BY 4.0.", "a Creative Commons Attribution 4.0 International License."], "CC-BY-SA-4.0": ["CC BY-SA 4.0.", "a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["the BSD 3-Clause License."], "BSD-2-Clause": ["the BSD 2-Clause License."], "MPL-2.0": ["the Mozilla Public License, Version 2.0.", "the Mozilla Public License 2.0."],
}
for _name, _called in _CALLED.items():
    TEMPLATES[_name] += [t for c in _called for v in _VERBS if (t := f"{v} under {c}") not in TEMPLATES[_name]]
#: Only the surroundings of these are searched; each template has one.
CUES = r"licen[cs]|cc by|permission|redistribut|free software|source code form"
#: Words that name a license: where one differs, it is another license.
NAMING = r"mit|isc|bsd|gnu|lgpl|agpl|gpl|lesser|library|affero|apache|mozilla|mpl|eclipse|cc|by(-.*)?|attribution(-.*)?|non-?commercial|share-?alike|no-?deriv.*|nc|sa|nd"
#: Share of a block's bytes that the template must save, and of words in which they may differ.
SAVED, WORDS = 0.5, 0.1
_cue = re.compile(CUES, re.I)
_word = re.compile(r"[\w-]+(?:\.\d+)*")
_naming = re.compile(NAMING)
#: The number of an item in a list.
_item = re.compile(r"(?:(?<=[.:;])|\A)\s+\(?\d[.)](?=\s)")
HITS = "doc_id long, license string, start long, length long, saved double, n_differences int, differences array<string>"


def _words(text: str) -> list[str]:
    return [w.lower() for w in _word.findall(text)]


@lru_cache(maxsize=1)
def _templates() -> list[tuple]:
    import zstandard

    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = _words(text)
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
            out.append((name, text, words, own))
    return out


@lru_cache(maxsize=1)
def _places() -> dict[str, list[tuple[int, int]]]:
    """Where templates have a word: (template, place)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, words, _) in enumerate(_templates()):
        for j, w in enumerate(words):
            out.setdefault(w, []).append((t, j))
    return out


@lru_cache(maxsize=1)
def _plain():
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(template: list[str], block: list[str]) -> list[str]:
    """Words to take out (-) of the template and to add (+), to get the block's wording."""
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes():
        if kind != "equal":
            out += [f"-{w}" for w in template[i:j]] + [f"+{w}" for w in block[k:m]]
    return out


def aligned(template: list[str], words: list[str], at: int, slack: int) -> tuple[int, int]:
    """Where the template's wording begins and ends among the words, near ``at``; what precedes and follows it is left out."""
    if words[max(at, 0) : at + len(template)] == template:
        return at, at + len(template)
    low = max(at - slack, 0)
    near = words[low : at + len(template) + slack]
    codes = difflib.SequenceMatcher(None, template, near, autojunk=False).get_opcodes()
    start, end = 0, len(near)
    kind, i, j, k, m = codes[0]
    if kind in ("insert", "replace"):
        start = max(m - (j - i), k)
    kind, i, j, k, m = codes[-1]
    if kind in ("insert", "replace"):
        end = min(k + (j - i), m)
    return low + start, low + max(start, end)


def candidate_blocks(words: list[str], near: list[range]) -> Iterator[tuple[int, int]]:
    """(template, first word): the shifts at which enough of a template's words stand in the words near a cue."""
    places, votes = _places(), {}
    for run in near:
        for i in run:
            for t, j in places.get(words[i], ()):
                own = votes.setdefault(t, {})
                own[i - j] = own.get(i - j, 0) + 1
    for t, own in votes.items():
        size = len(_templates()[t][2])
        slack = int(2 * WORDS * size)
        tried: set[int] = set()
        # Each word taken out or added shifts what follows, so shifts within the allowed differences count together.
        for shift in sorted((s for s, n in own.items() if n > 1), key=lambda s: (-own[s], s)):
            if not any(abs(s - shift) <= 2 * slack for s in tried) and sum(own.get(s, 0) for s in range(shift - slack, shift + slack + 1)) >= size - slack:
                tried.add(shift)
                yield t, shift


def scan(text: str) -> list[tuple]:
    """(license, start, length, saved, differences) of each block whose wording is a template's."""
    text_words = list(_word.finditer(_item.sub(lambda m: " " * len(m.group()), text)))
    starts, words = [m.start() for m in text_words], [m.group().lower() for m in text_words]
    reach = max(len(t[2]) for t in _templates()) * 5 // 4
    near: list[range] = []
    for m in _cue.finditer(text):
        i = bisect.bisect_right(starts, m.start())
        low, high = max(i - reach, near[-1].stop if near else 0, 0), min(i + reach, len(words))
        if low < high:
            near.append(range(low, high))
    ranked, found_at = [], set()
    for t, at in candidate_blocks(words, near):
        name, template_text, template, compressor = _templates()[t]
        first, last = aligned(template, words, at, int(2 * WORDS * len(template)))
        if first >= last or (t, first, last) in found_at:
            continue
        found_at.add((t, first, last))
        block = words[first:last]
        data = " ".join(block).encode("utf-8", "replace")  # case and line ends do not count
        alone, given = len(_plain().compress(data)), len(compressor.compress(data))
        saved = (alone - given) / max(alone, 1)
        if saved < SAVED:
            continue
        found = differences(template, block)
        # Numbers are versions: another version is another license.
        if len(found) > 2 * WORDS * len(template) or any(any(c.isdigit() for c in w) or _naming.fullmatch(w[1:]) for w in found):
            continue
        start, end = starts[first], text_words[last - 1].end()
        end += text[end : end + 1] == template_text[-1]
        ranked.append((given - alone, len(found), start, name, end, saved, found))
    out: list[tuple] = []
    for _, _, start, name, end, saved, found in sorted(ranked):
        if all(end <= s or start >= s + size for _, s, size, _, _ in out):
            out.append((name, start, end - start, round(saved, 6), found))
    return sorted(out, key=lambda r: r[1])


def license_hits(docs: DataFrame) -> DataFrame:
    """One row for each license text in a document: doc_id, license, start, length, saved, n_differences, differences.

    Blocks are sought around every cue, wherever it stands in its line: a template's words
    are matched at all shifts against those of the text, and where enough of them meet, the
    block that the template's words align with is compressed alone and with the template as a
    raw dictionary. It is a hit if half of its bytes are saved, and its words differ from the
    template's in a tenth at most, and in no number and no word that names a license. Of hits
    that overlap, the one that saves the most bytes stays (of equals the one with the fewest
    differences, then the first). start and length count characters.

    Null and empty texts have no hits; repeated rows have theirs each; a null doc_id stays
    null; empty tables give no rows, and other columns are not read. Nothing is shuffled.
    """
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, rows = frame["doc_id"], []
            for i, text in enumerate(frame["text"].tolist()):
                rows += [(i, n, s, size, saved, len(d), d) for n, s, size, saved, d in scan(text)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "start", "length", "saved", "n_differences", "differences"])
            yield out.assign(doc_id=ids.iloc[out["doc_id"].astype("int64")].array)

    # Ids pass through Python as text: a null beside them would make them floats.
    chosen = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).where(F.col("text").rlike(f"(?i){CUES}"))
    return chosen.mapInPandas(find, HITS.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
