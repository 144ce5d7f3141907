"""License scans by conditional compression.

Candidate blocks are the words of a text around each mention of licensing, as many on either side as the longest template
sentence can span, over the ends of lines and paragraphs. The sentences of each license template are aligned with a block,
so that prose around a notice is free. A place is a candidate if the words of the sentence that it lacks and those that it has in between are few, and
none of the words and versions that tell the template from its rivals is lacking. The text of the place is compressed
alone and with the template as a raw zstandard dictionary, which must save a good part of it. Of several templates at one
place the one with the least difference wins, then the one that saves most; other places of the block count by themselves.

The scan is a map over rows: nothing is shuffled, and memory is bounded by one batch and the fixed templates.

Defined results: null and empty texts have no blocks and no license; the first of equal savings by template id wins;
a text with several licenses returns them all, in order of their ids; repeated rows give a row each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

#: License templates: notices and the opening terms of the licenses (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice. Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain. Released under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. The software is provided \"as is\", without warranty of any kind.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved. Confidential and proprietary. Unauthorized copying or distribution is prohibited.",
}
#: Mentions that make a line a candidate.
MENTION = re.compile(r"licen[sc]|copyright|warrant|permission is hereby|redistribut|rights reserved|public domain|spdx|\bGPL\b|\bMPL\b|creative commons", re.IGNORECASE)
#: What each alternative of MENTION holds, once ``_folded``; a text without any has no mention.
_HINTS = ("licen", "copyright", "warrant", "permission is hereby", "redistribut", "rights reserved", "public domain", "spdx", "gpl", "mpl", "creative commons")
#: Most characters on either side of a mention in a sentence that is confirmed by no template.
WINDOW = 400
#: Least saving by the template's dictionary, and most words that differ, as shares.
LEAST_SAVING, MOST_DIFFERENT, LEVEL = 0.25, 0.2, 6

_WORD, _ANY_WORD = re.compile(r"[a-z0-9][a-z0-9.\-]*"), re.compile(r"[A-Za-z0-9][A-Za-z0-9.\-]*")
#: Line breaks with the marks of comments after them, other white space, and the ends of sentences.
_BREAK, _STOP = re.compile(r"\s*\n[\s#*/;%!>-]*|\s+"), re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(])|\n\s*\n")

_dictionaries: dict[str, zstandard.ZstdCompressor] = {}


def _compressors() -> dict[str, zstandard.ZstdCompressor]:
    if not _dictionaries:
        plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        _dictionaries[""] = zstandard.ZstdCompressor(compression_params=plain)
        for k, t in TEMPLATES.items():
            _dictionaries[k] = zstandard.ZstdCompressor(compression_params=plain, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return _dictionaries


def words(text: str) -> list[str]:
    return [w.strip(".") for w in _WORD.findall(text.lower())]


@functools.cache
def sentences(template: str) -> list[list[str]]:
    """The word lists of a template's sentences: a notice may quote one of them alone."""
    return [w for s in re.split(r"(?<=[a-z\")0-9])\.\s+(?=[A-Z])", TEMPLATES[template]) if len(w := words(s)) >= 2]


@functools.cache
def telling(template: str) -> frozenset[str]:
    """Words of a template's notices by which it differs from some close rival, versions and names above all."""
    own = {w for s in sentences(template) for w in s}
    rivals = [{w for s in sentences(k) for w in s} for k in TEMPLATES if k != template]
    close = [r for r in rivals if len(own & r) >= 0.5 * min(len(own), len(r))]
    return frozenset(w for w in own if any(w not in r for r in close) and (any(c.isdigit() for c in w) or "-" in w or len(w) > 3))


@functools.cache
def reach() -> int:
    """Words on either side of a mention that a confirmed wording of any template can span."""
    longest = max(len(s) for k in TEMPLATES for s in sentences(k))
    return longest + int(MOST_DIFFERENT * longest)


def _folded(text: str) -> str:
    """``text`` in lower case, with the letters beyond ASCII that IGNORECASE takes for i and s as these."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")


def blocks(text: str) -> list[str]:
    """Candidate blocks of a whole text: ``reach`` words on either side of each mention, whatever the lines; blocks that meet are one."""
    low = _folded(text)
    if not any(h in low for h in _HINTS):
        return []
    mentions = np.array([(m.start(), m.end()) for m in MENTION.finditer(text)], np.int64).reshape(-1, 2)
    if not len(mentions):
        return []
    at = np.fromiter((x for m in _ANY_WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    # The first word that ends after a mention begins, and the first that begins after it ends.
    first = np.maximum(np.searchsorted(at[:, 1], mentions[:, 0], "right") - reach(), 0)
    last = np.minimum(np.searchsorted(at[:, 0], mentions[:, 1], "left") + reach(), len(at))
    new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
    return [text[at[i, 0] : at[j - 1, 1]] for i, j in zip(first[new], np.append(last[new[1:] - 1], last[-1]), strict=True)]


@functools.lru_cache(4_096)
def savings(block: str) -> list[tuple[float, str]]:
    """(share saved, template), best first."""
    raw = block.lower().encode()
    c = _compressors()
    alone = len(c[""].compress(raw))
    return sorted(((1 - len(c[k].compress(raw)) / alone, k) for k in TEMPLATES), key=lambda x: (-x[0], x[1]))


def places(sentence: list[str], needed: frozenset[str], block: list[str]) -> list[tuple[int, int, int]]:
    """(words that differ, first word, end) of the places in ``block`` where at most MOST_DIFFERENT of a sentence differs, best first.

    Words that a place lacks and words that it has in between count one each; needed words can't be lacking, and what
    stands before and after a place is free. A row of the table is a number for each end: cost above, begin below.
    """
    most, n = int(MOST_DIFFERENT * len(sentence)), len(block)
    held = set(block)
    if sum(w not in held for w in sentence) > most or not needed.intersection(sentence) <= held:
        return []
    code = {w: i for i, w in enumerate(dict.fromkeys(sentence))}
    own = np.array([code.get(w, -1) for w in block], np.int64)
    step = np.arange(n + 1, dtype=np.int64) << 32
    row = n - np.arange(n + 1, dtype=np.int64)  # the latest begin wins among equals
    for w in sentence:
        new = row + ((1 if w not in needed else 1 << 20) << 32)
        new[1:] = np.minimum(new[1:], np.where(own == code[w], row[:-1], np.int64(1 << 61)))
        row = np.minimum.accumulate(new - step) + step
    cost, begin = row >> 32, n - (row & 0xFFFFFFFF)
    ends = np.flatnonzero(cost <= most)
    out, taken = [], np.zeros(n, bool)
    for e in ends[np.argsort(cost[ends], kind="stable")]:
        if begin[e] < e and not taken[begin[e] : e].any():
            taken[begin[e] : e] = True
            out.append((int(cost[e]), int(begin[e]), int(e)))
    return out


def wordings(block: str) -> list[tuple[float, float, str, int, int, int]]:
    """(share of differing words, minus share saved, license, words that differ, first word, end) of all confirmed wordings, best first.

    Only the words of the place are compressed, so what surrounds a notice doesn't count.
    """
    low = block.lower()
    at = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    own = [low[s:e].strip(".") for s, e in at]
    out = []
    for k in TEMPLATES:
        for s in sentences(k):
            for cost, i, j in places(s, telling(k), own):
                saved = dict((x, y) for y, x in savings(_BREAK.sub(" ", low[at[i][0] : at[j - 1][1]])))[k]
                if saved >= LEAST_SAVING:
                    out.append((cost / len(s), -saved, k, cost, i, j))
    return sorted(out)


def mentioned(block: str) -> str:
    """The sentence of ``block`` around its first mention, within WINDOW characters on either side."""
    m = MENTION.search(block)
    if not m:
        return block[: 2 * WINDOW]
    before, after = block[max(0, m.start() - WINDOW) : m.start()], block[m.start() : m.end() + WINDOW]
    return _BREAK.sub(" ", _STOP.split(before)[-1] + _STOP.split(after)[0])


def notices(block: str) -> list[tuple[str, float, int]]:
    """(license, share saved, words that differ) of every license that a block has, the best of each; of several at one place the best stays."""
    out, found = {}, wordings(block)
    owner = np.full(max((x[-1] for x in found), default=0), "", "U32")
    for _, saved, k, n, i, j in found:
        if np.isin(owner[i:j], ("", k)).all():
            owner[i:j] = k
            out.setdefault(k, (k, -saved, n))
    return list(out.values())


def identify(block: str) -> tuple[str | None, float, int]:
    """The first of a block's ``notices``; no license if no template is confirmed."""
    got = notices(block)
    return got[0] if got else (None, savings(mentioned(block))[0][0], 0)


RESULT = "doc_id long, n_blocks long, license string, licenses array<string>, saving double, n_different long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its candidate blocks, the confirmed license that saves most, and all confirmed ones."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                cut = blocks(t.as_py() or "")
                got = [y for x in cut for y in notices(x) or [identify(x)]]
                sure = sorted((x for x in got if x[0]), key=lambda x: (-x[1], x[0]))
                top = sure[0] if sure else (None, max((x[1] for x in got), default=None), None)
                rows.append((len(cut), top[0], sorted({x[0] for x in sure}), None if top[1] is None else round(top[1], 6), top[2]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_blocks", "license", "licenses", "saving", "n_different"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
