"""License scans by conditional compression.

Around each cue of licensing, a block of words wider than any template is taken, whatever lines it spans. A license's template
is all it is stated by: its text where that is short, its notices, and the usual forms with its names. The block is compressed
with each license's template as a raw zstandard dictionary, and licenses are ranked by what that saves. From the top of the
rank down, a license that saves anything to speak of is confirmed by exact wording: the block's words are aligned with those
of the template's texts, few may differ, and none of those that tell licenses apart (names, versions, conditions). The first
that is confirmed is a statement; what is left of the block on either side is ranked again, until nothing is confirmed. So
only compression brings up a license, and there is no limit on how many are tried.

Names are too short to be compressed by themselves: those that follow a statement after "and", "or" and the like are looked up.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: notices that public licenses give or that are usual for them, by SPDX identifier
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License v2.0 or later",
        "GNU General Public License, version 2 or later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License v3.0 or later",
        "GNU General Public License, version 3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("Licensed under the zlib License.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
}

# fixed values: whole texts of short licenses, without their copyright lines
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}
# fixed values: names that statements give licenses, by SPDX identifier
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC0-1.0": ("CC0 1.0",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "Zlib"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "BSL-1.0"),
}
FORMS = ("licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "distributed under the {}", "available under the {}", "available under {}", "under the terms of the {}", "{} licensed", "SPDX-License-Identifier: {}")
#: Words that every statement has one of; there is no block around other words.
CUES = ("licens", "permission", "redistribut", "copyright", "public domain", "cc0", "free software", "under the terms", "released under", "distributed under", "available under")
CUE = "(?i)" + "|".join(CUES).replace(" ", r"[\W_]+")
#: Words that tell one license from another, besides those with a digit in them.
TELLING = frozenset("mit apache gnu general lesser affero mozilla bsd isc cc by nc sa nd attribution sharealike noncommercial noderivatives clause unencumbered merge sublicense binary fee not neither endorse promote zlib boost unlicense gpl lgpl agpl misrepresented".split())
LEVEL = 3
#: Bytes that a license's template has to save before its wording is looked at.
LEAST = 1
#: Words on either side of a cue that are compressed by themselves, more closely, where the whole block brought up nothing.
NEAR = 12
NEAR_LEVEL = 19
DIFFERING = 0.15
_WORD = re.compile(r"[^\W_]+", re.U)
_AND = re.compile(r"[\s,/&()+*#-]*(?:(?:and|or|the|under|either|as|well|a|later)\b[\s,/&()+*#-]*)*", re.I)
_NO = re.compile(r"(?:\b(?:not|never|neither|nor|no longer|cannot)|n['\u2019]t)\b[^.!?;:]{0,24}$", re.I)


class Text(NamedTuple):
    words: list[str]
    telling: frozenset[str]
    most: float  # words that may differ


class License(NamedTuple):
    name: str
    texts: list[Text]  # the longest first
    names: list[list[str]]
    compressors: dict[int, zstandard.ZstdCompressor]  # by level


def _words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def _tells(w: str) -> bool:
    return w in TELLING or any(c.isdigit() for c in w)


def statements_of(name: str) -> list[str]:
    """All texts that state a license."""
    own = [f.format(n) for n in NAMES.get(name, ()) for f in FORMS]
    return [*([TEXTS[name]] if name in TEXTS else []), *TEMPLATES.get(name, ()), *own]


def _compressors(template: str | None = None) -> dict[int, zstandard.ZstdCompressor]:
    out = {}
    for level in (LEVEL, NEAR_LEVEL):
        data = None
        if template:
            data = zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
        out[level] = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False)
    return out


@lru_cache(1)
def _licenses() -> list[License]:
    out = []
    for name in TEMPLATES:
        every = sorted({tuple(_words(t)) for t in statements_of(name)}, key=lambda w: (-len(w), w))
        texts = [Text(list(w), frozenset(filter(_tells, w)), DIFFERING * len(w)) for w in every]
        names = sorted((_words(n) for n in NAMES[name]), key=len, reverse=True)
        out.append(License(name, texts, names, _compressors("\n".join(" ".join(w) for w in every))))
    return out


@lru_cache(1)
def _plain() -> dict[int, zstandard.ZstdCompressor]:
    return _compressors()


def savings(block: str, level: int = LEVEL) -> list[tuple[int, float, License]]:
    """Bytes that each license's template saves of the compressed block, and their share of it, most first."""
    raw = block.encode("utf-8", "surrogatepass")
    plain = len(_plain()[level].compress(raw))
    saved = [(plain - len(x.compressors[level].compress(raw)), x) for x in _licenses()]
    return [(n, n / plain, x) for n, x in sorted(saved, key=lambda s: (-s[0], s[1].name))]


def wording(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """Span of the template's place among the words, with the words missing and added; None if they share none."""
    same = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return None
    # the place is where the longest match would put the template; only words within it count as added
    top = max(same, key=lambda m: m.size)
    slack = max(3, len(template) // 4)
    lo, hi = max(top.b - top.a - slack, 0), min(top.b - top.a + len(template) + slack, len(words))
    part = words[lo:hi]
    same = [m for m in SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if m.size]
    start, stop = same[0].b, same[-1].b + same[-1].size
    in_a, in_b = {i for m in same for i in range(m.a, m.a + m.size)}, {i for m in same for i in range(m.b, m.b + m.size)}
    return lo + start, lo + stop, [w for i, w in enumerate(template) if i not in in_a], [part[i] for i in range(start, stop) if i not in in_b]


def _find(text: Text, words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """A place of the text among the words from which few words differ and none that tells licenses apart."""
    if text.most < 1:
        line, part = " " + " ".join(words) + " ", " " + " ".join(text.words) + " "
        at = line.find(part)
        return None if at < 0 else (start := line.count(" ", 0, at), start + len(text.words), [], [])
    need, parts = Counter(text.words), [(0, len(words))]
    while parts:
        lo, hi = parts.pop()
        if len(text.words) - (need & Counter(words[lo:hi])).total() > text.most or not (got := wording(text.words, words[lo:hi])):
            continue
        start, stop, missing, added = got
        if len(missing) + len(added) <= text.most and not any(map(_tells, missing + added)):
            return lo + start, lo + stop, missing, added
        parts += [(lo, lo + start), (lo + stop, hi)]
    return None


def confirm(lic: License, words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """Where the words state the license: the place of its longest text, less two words for each that differs."""
    there, best, most = set(words), None, 0
    for t in lic.texts:
        if len(t.words) > most and t.telling <= there and (got := _find(t, words)) and (n := len(t.words) - 2 * len(got[2] + got[3])) > most:
            best, most = got, n
    return best


@lru_cache(1)
def _reach() -> int:
    """Words that a statement may have on either side of a cue."""
    return max(len(t.words) + max(3, len(t.words) // 4) for x in _licenses() for t in x.texts)


def _blocks(words: list[str]) -> list[tuple[int, int]]:
    """Ranges of words around cues; where they overlap for long they are cut so that each statement lies in one whole."""
    n = _reach()
    spans: list[list[int]] = []
    for c in _cues(words):
        if spans and c - n <= spans[-1][1]:
            spans[-1][1] = min(c + n + 1, len(words))
        else:
            spans.append([max(c - n, 0), min(c + n + 1, len(words))])
    return [(i, min(i + 4 * n, hi)) for lo, hi in spans for i in range(lo, max(hi - 2 * n, lo + 1), 2 * n)]


def _cues(words: list[str]) -> list[int]:
    text = " ".join(words)
    gaps = [m.start() for m in re.finditer(" ", text)]
    return sorted({bisect_right(gaps, m.start()) for m in re.finditer(CUE, text)})


def _ranked(words: list[str], level: int) -> tuple[str, float, int, int, list[str], list[str]] | None:
    """The first license in the rank of what templates save that the wording confirms."""
    for saved, share, lic in savings(" ".join(words), level):
        if saved < LEAST:
            return None
        if got := confirm(lic, words):
            return lic.name, share, *got
    return None


def _stated(words: list[str]) -> list[tuple[str, float, int, int, list[str], list[str]]]:
    """Statements in a block, brought up by compression: the best of the rank that is confirmed, then what is left on its sides.

    Where nothing is confirmed, the words next to each cue are blocks of their own: in a wide block what a short statement
    saves can be lost in the rest.
    """
    out, parts = [], [(0, len(words))]
    while parts:
        lo, hi = parts.pop()
        cues = [lo + c for c in _cues(words[lo:hi])]
        wide = [(lo, hi, LEVEL)] if cues else []
        for i, j, level in wide + [(max(c - NEAR, lo), min(c + NEAR + 1, hi), NEAR_LEVEL) for c in cues]:
            if got := _ranked(words[i:j], level):
                name, share, start, stop, missing, added = got
                out.append((name, share, i + start, i + stop, missing, added))
                parts += [(lo, i + start), (i + stop, hi)]
                break
    return out


def _follower(words: list[str]) -> tuple[str, int] | None:
    """The license whose name the words begin with, and how many words that is; the longest name."""
    hits = [(len(n), x.name) for x in _licenses() for n in x.names if words[: len(n)] == n]
    return (lambda h: (h[1], h[0]))(max(hits)) if hits else None


def scan_block(block: str) -> list[tuple[str, float, int, int, int, list[str], list[str]]]:
    """Licenses that a text states: ``(id, saving, start, stop, n_differing, missing, added)``, in words of the text.

    Statements do not overlap. One that stands behind a negation in its sentence is left out. A name that follows a statement
    after "and", "or" and the like is a statement with the other's saving.
    """
    at = [m.span() for m in _WORD.finditer(block)]
    words = ["".join(_words(block[i:j])) for i, j in at]
    found: dict[tuple[int, int], tuple] = {}
    for lo, hi in _blocks(words):
        for name, share, start, stop, missing, added in _stated(words[lo:hi]):
            found.setdefault((lo + start, lo + stop), (name, share, lo + start, lo + stop, len(missing) + len(added), missing, added))
    kept: list[tuple] = []
    for h in sorted(found.values(), key=lambda h: (h[2] - h[3], h[4], h[2])):  # seen in two blocks, one may be cut there
        if all(h[3] <= o[2] or h[2] >= o[3] for o in kept):
            kept.append(h)
    out = []
    for h in sorted(kept, key=lambda h: h[2]):
        if _NO.search(block, max(at[h[2]][0] - 40, 0), at[h[2]][0]):
            continue
        out.append(h)
        stop = h[3]
        while stop < len(at) and (gap := _AND.match(block, at[stop - 1][1])):
            i = bisect_right(at, (gap.end(), -1))
            if i >= len(at) or at[i][0] != gap.end() or any(o[2] <= i < o[3] for o in kept) or not (name := _follower(words[i : i + 12])):
                break
            stop = i + name[1]
            out.append((name[0], h[1], i, stop, 0, [], []))
    return sorted(out, key=lambda h: h[2])


def scan(docs: DataFrame) -> DataFrame:
    """A row per license statement: ``doc_id, line, license, saving, start, stop, n_differing, missing, added, wording``.

    ``line`` is where a statement begins, from 0; ``start`` and ``stop`` are word positions from that line's first word,
    ``wording`` the lines that hold it. Documents without a statement, and null or empty texts, give no row; a repeated
    row gives its own.
    """

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(10)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not (hits := scan_block(text)):
                    continue
                lines, at = text.split("\n"), [m.start() for m in _WORD.finditer(text)]
                begins = [0, *(m.end() for m in re.finditer("\n", text))]
                for name, saving, start, stop, n, missing, added in hits:
                    line, end = (bisect_right(begins, at[i]) - 1 for i in (start, stop - 1))
                    first = len(_WORD.findall(text[begins[line] : at[start]]))
                    for c, v in zip(cols, (doc, line, name, saving, first, first + stop - start, n, " ".join(missing), " ".join(added), "\n".join(lines[line : end + 1])), strict=True):
                        c.append(v)
            kinds = [b.schema.field("doc_id").type, pa.int32(), pa.string(), pa.float64(), *[pa.int32()] * 3, *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "line", "license", "saving", "start", "stop", "n_differing", "missing", "added", "wording"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("text").rlike(CUE)).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line int, license string, saving double, start int, stop int, n_differing int, missing string, added string, wording string")
