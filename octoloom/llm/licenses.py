"""License scans by conditional compression.

Words of licensing mark candidate blocks: at each mark, each template that has the word is laid so
that the two meet, and the words under it (with a tenth to spare on both sides) are a block.  A block
is compressed plain and with the template as a raw zstandard dictionary: the bytes saved, as a
share of what the template saves on itself, rank the templates.  Ranked templates are then
confirmed by their exact wording: the words of the template missing from the block, and the words
of the block put between them, must stay within a tenth of the template, and the words that tell
licenses apart (names, versions, Lesser, NonCommercial and such) must be the same.  Where confirmed
places of different licenses overlap, the one with the most words counts.  SPDX identifiers are read
as they stand, and so are fields such as ``license: MIT``.

Blocks are as long as a template, however long the text; texts are read whole.  A template is laid only
where its telling words stand, and one of so many of its longest words that they cannot all be missing: what is left
out so could not have been confirmed.  Equal blocks are compressed once.
Documents are scored where they lie; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a template's own saving from which a block is confirmed.
LEAST_GAIN = 0.4
#: Words missing or put between, as a share of the template.
MOST_CHANGED = 0.1
LEVEL = 9

MARK = r"licen[cs]|copyright|reserved|spdx|redistribut|permission|warrant|domain"
ANCHOR = f"(?i){MARK}"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_NEITHER = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
#: Licenses that notices name in full.  Fixed values.
BY_NAME = (
    ("Apache-1.1", "Apache License, Version 1.1"),
    ("Artistic-2.0", "Artistic License, version 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal license"),
    ("CDDL-1.0", "Common Development and Distribution License, version 1.0"),
    ("EPL-1.0", "Eclipse Public License, version 1.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("EUPL-1.2", "European Union Public Licence, version 1.2"),
    ("ISC", "ISC License"),
    ("MPL-1.1", "Mozilla Public License, version 1.1"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("OFL-1.1", "SIL Open Font License, Version 1.1"),
    ("PostgreSQL", "PostgreSQL License"),
    ("Unlicense", "Unlicense"),
    ("Zlib", "zlib License"),
)
#: Notices and texts by the names that SPDX gives the licenses.  Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. " + _AS_IS,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("BSD-2-Clause", _BSD_2),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("LicenseRef-reserved", "All rights reserved."),
    *(
        (f"{short}-{number}.0" if "." not in number else f"{short}-{number}", text.format(name=name, number=number))
        for short, name, number in (
            ("GPL", "General", "2"), ("GPL", "General", "3"), ("LGPL", "Library General", "2"),
            ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3"),
        )
        for text in (
            "This work is licensed under the GNU {name} Public License, version {number}.",
            "Licensed under the GNU {name} Public License, version {number}.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
            "Public License as published by the Free Software Foundation; either version {number} of the License, or "
            "(at your option) any later version.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
            "Public License version {number} as published by the Free Software Foundation.",
        )
    ),
    ("BSD-3-Clause", _BSD_2 + " 3. " + _NEITHER),
    (
        "BSD-4-Clause",
        _BSD_2 + " 3. All advertising materials mentioning features or use of this software must display the "
        "following acknowledgement: This product includes software developed by the copyright holder. 4. " + _NEITHER,
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.",
    ),
    *((i, f"{verb} under the {name}.") for i, name in BY_NAME for verb in ("Licensed", "Released")),
    (
        "MPL-1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
        "this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.mozilla.org/MPL/",
    ),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
        "source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so.",
    ),
    (
        "WTFPL",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing "
        "it is allowed as long as the name is changed.",
    ),
    *((f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *(
        (f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.")
        for kind, name in (
            ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ),
)

#: Words that tell licenses apart wherever they stand.
_NAMES = re.compile(
    r"lesser|affero|gnu|apache|mozilla|mit|bsd|isc|\d-clause|artistic|boost|cc0|eclipse|european|ncsa|sil|postgresql|zlib|.*(?:non-?commercial|share-?alike|no-?deriv).*"
)
_VERSION = re.compile(r"(?:[a-z]*-|v)?(\d+(?:\.\d+)+)|v(\d+)")
#: Where one of the words before a notice, in its clause, is such, it says what does not hold.
_DENIED = {"not", "never", "nor", "longer", "isn", "cannot"}
_DENIED_WITHIN = 3
#: These deny from further off, but not across a comma.
_NONE = {"no", "none", "neither", "nothing"}
_NONE_WITHIN = 6
_SENTENCE = re.compile(r"[.!?;:]\s|\n\s*\n|\bbut\b")
_COMMA = re.compile(r",\s")
#: What may stand for "licensed" before "under".
_VERBS = {"released", "distributed", "available", "published", "provided", "offered", "issued"}
#: Names that may stand after "under" without an article.
_SHORT = {"mit", "apache", "isc", "zlib"}
#: How far on "or" may stand after "either".
_EITHER_WORDS = 14
#: What follows a license's words where they are only the first part of another's.
_GOES_ON = {"BSD-2-Clause": re.compile(r"\b(?:neither|advertising)\b")}
_GOES_ON_WORDS = 12

_SPDX_ID = r"(?:\(\s*)*[A-Za-z0-9][A-Za-z0-9.+-]*(?:\s*\))*"
_SPDX = re.compile(rf"(?i:SPDX-License-Identifier):\s*({_SPDX_ID}(?:\s+(?:OR|AND|WITH|or|and|with)\s+{_SPDX_ID})*)")
_KNOWN_IDS = {
    i.lower(): i
    for i in (
        *(name for name, _ in TEMPLATES), *"MPL-1.1 EPL-1.0 EPL-2.0 Zlib BSL-1.0 CC0-1.0 WTFPL PostgreSQL MIT-0 GPL-1.0".split(),
        *"Artistic-2.0 EUPL-1.2 Python-2.0 X11 NCSA CDDL-1.0 OFL-1.1 AFL-3.0 MS-PL Ruby Vim Beerware curl".split(),
    )
}

_FIELD = re.compile(
    rf"(?m)(?i:\blicen[cs]e)[\"']?[ \t]*[:=][ \t]*[\"']?({_SPDX_ID}(?:\s+(?:OR|AND|WITH|or|and|with)\s+{_SPDX_ID})*)[\"']?[ \t]*(?=[.,;)}}\]]?\s*$|[,;)}}\]])"
)

_MARK = re.compile(MARK)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _telling(words: list[str]) -> Iterator[tuple[int, str]]:
    for i, word in enumerate(words):
        version = _VERSION.fullmatch(word)
        if version:
            yield i, re.sub(r"(?:\.0)+$", "", version[1] or version[2])
        elif word.isdigit() and i and words[i - 1] in ("version", "v"):
            yield i, word
        elif _NAMES.fullmatch(word) or (word == "library" and words[i + 1 : i + 2] == ["general"]):
            yield i, word


def telling(words: list[str]) -> list[str]:
    """The words that tell licenses apart, in order; 3, 3.0 and v3 are one version."""
    return [word for _, word in _telling(words)]


def _as_notices(words: list[str]) -> Iterator[tuple[str, int]]:
    """(word, index of the word that it comes from)."""
    last: tuple[str, ...] = ("", "")
    either, article = 0, False
    for i, word in enumerate(words):
        if word in _VERBS and words[i + 1 : i + 2] == ["under"]:
            word = "licensed"
        opened = last == ("licensed", "under")
        if opened and word == "either":
            either, article = _EITHER_WORDS, True
            continue
        if either and article and word == "of":
            continue
        if either and word == "or":
            yield "licensed", i
            yield "under", i
            last, either, article = ("licensed", "under"), 0, True
            continue
        if (article or (opened and word in _SHORT)) and word != "the":
            yield "the", i
        article, either = False, max(0, either - 1)
        yield word, i
        last = (last[1], word)


def as_notices(words: list[str]) -> list[str]:
    """Words with one way to say "licensed under the", and "under either of A or B" said twice."""
    return [word for word, _ in _as_notices(words)]


def fields(text: str) -> set[str]:
    """The licenses of fields, such as ``license: MIT`` or ``"license": "Apache-2.0"``; only what is an identifier."""
    names = set()
    for line in _FIELD.finditer(text):
        parts = re.findall(r"[A-Za-z0-9][A-Za-z0-9.+-]*", line[1])
        known = [_KNOWN_IDS.get(re.sub(r"(?i)(?:-only|-or-later|\+)$", "", p.rstrip(".-")).lower()) for p in parts if p.lower() not in ("or", "and")]
        if all(known):
            names.update(known)
    return names


def spdx_names(text: str) -> set[str]:
    """The licenses of all SPDX lines, without -only, -or-later, + and exceptions."""
    names = set()
    for line in _SPDX.finditer(text):
        before = ""
        for part in re.findall(r"[A-Za-z0-9][A-Za-z0-9.+-]*", line[1]):
            if part.lower() in ("or", "and", "with"):
                before = part
                continue
            plain = re.sub(r"(?i)(?:-only|-or-later|\+)$", "", part.rstrip(".-"))
            known = _KNOWN_IDS.get(plain.lower())
            if before.islower() and not known:
                break  # the sentence goes on in prose
            looks = re.search(r"\d|^[A-Z]", plain) and plain.upper() not in ("NONE", "NOASSERTION")
            if before.upper() != "WITH" and (known or looks):
                names.add(known or plain)
    return names


@dataclass(frozen=True)
class Found:
    license: str
    gain: float
    missing: int
    added: int


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, as_notices(normal_words(text))
        self.body = " ".join(self.words).encode()
        self.slack = int(len(self.words) * MOST_CHANGED)
        self.marks = [(stem[0], k) for k, w in enumerate(self.words) if (stem := _MARK.search(w))]
        if not self.marks:
            raise ValueError(f"template without a word of licensing: {name}")
        dictionary = zstandard.ZstdCompressionDict(self.body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.with_dict = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)
        self.telling = telling(self.words)
        # if none of these stands in a block, more words are missing than may be
        self.distinct = set(self.words)
        self.needed = sorted(self.distinct, key=lambda w: (bool(_MARK.search(w)), -len(w), w))[: self.slack + 1]
        self.own = max(1, _plain(self.body) - len(self.with_dict.compress(self.body)))

    def gain(self, block: bytes, plain: int) -> float:
        return (plain - len(self.with_dict.compress(block))) / self.own

    def differences(self, block: list[str]) -> tuple[int, int, int, int]:
        """Template words missing from the best place of the block, words put between, and that place."""
        runs = SequenceMatcher(None, self.words, block, autojunk=False).get_matching_blocks()[:-1]
        matched = sum(r.size for r in runs)
        if not matched:
            return len(self.words), 0, 0, 0
        first, end = runs[0].b, runs[-1].b + runs[-1].size
        return len(self.words) - matched, end - first - matched, first, end


def _plain(block: bytes) -> int:
    return len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(block))


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.by_mark: dict[str, list[tuple[Template, int]]] = {}
        for template in [Template(*t) for t in templates]:
            for stem, place in template.marks:
                self.by_mark.setdefault(stem, []).append((template, place))

    def scan(self, text: str | None) -> list[Found]:
        """The confirmed licenses of a text, one each with its closest wording, by name."""
        if not text or not re.search(ANCHOR, text):
            return []
        page = Page(text)
        laid = {stem: [x for x in of_stem if page.may_hold(x[0])] for stem, of_stem in self.by_mark.items()}
        places: dict[tuple[int, int, str], Found] = {}
        for at, word in enumerate(page.words):
            stem = _MARK.search(word)
            for first, end, found in self._confirmed(page, at, laid.get(stem[0], ())) if stem else ():
                old = places.get((first, end, found.license))
                if old is None or _order(found) < _order(old):
                    places[first, end, found.license] = found
        best = {name: Found(name, 1.0, 0, 0) for name in spdx_names(text) | fields(text)}
        for found in _winners(places):
            if found.license not in best or _order(found) < _order(best[found.license]):
                best[found.license] = found
        return sorted(best.values(), key=lambda f: f.license)

    def _confirmed(self, page: Page, at: int, laid: list[tuple[Template, int]]) -> Iterator[tuple[int, int, Found]]:
        words, ranked = page.words, []
        for k, (template, place) in enumerate(laid):
            first = max(0, at - place - template.slack)
            last = max(0, at - place + len(template.words) + template.slack)
            if page.may_hold(template, first, last):
                ranked.append((page.gain(template, first, last), -k, first, words[first:last]))
        for gain, k, start, block in sorted(ranked, reverse=True):
            if gain < LEAST_GAIN:
                return
            template = laid[-k][0]
            missing, added, first, end = page.differences(template, block)
            if missing + added > len(template.words) * MOST_CHANGED or telling(block[first:end]) != template.telling:
                continue
            if page.denied(start + first):
                continue
            goes_on = _GOES_ON.get(template.name)
            if goes_on and goes_on.search(" ".join(words[start + end : start + end + _GOES_ON_WORDS])):
                continue
            yield start + first, start + end, Found(template.name, round(gain, 4), missing, added)


class Page:
    """A text's words, where each stands, and what has been found of equal blocks."""

    HELD = 20_000

    def __init__(self, text: str):
        text = text.lower()
        found = list(_WORD.finditer(text))
        pairs = list(_as_notices([m[0] for m in found]))
        self.words = [word for word, _ in pairs]
        places = [found[i].start() for _, i in pairs]
        # words before which a sentence, or what follows a comma, begins
        self.opens, self.parts = (
            {bisect_left(places, m.end()) for m in mark.finditer(text)} | {0} for mark in (_SENTENCE, _COMMA)
        )
        self.where: dict[str, list[int]] = {}
        for i, word in enumerate(self.words):
            self.where.setdefault(word, []).append(i)
        self.told: dict[str, list[int]] = {}
        for i, word in _telling(self.words):
            self.told.setdefault(word, []).append(i)
        self.gains: dict[tuple[int, bytes], float] = {}
        self.compared: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}

    def may_hold(self, template: Template, first: int = 0, last: int | None = None) -> bool:
        """False where the words in [first, last) cannot be confirmed as the template."""
        if last is None:
            last = len(self.words)
            if sum(w in self.where for w in template.distinct) < len(template.distinct) - template.slack:
                return False

        def stands(places: list[int] | None) -> bool:
            k = bisect_left(places, first) if places else 0
            return bool(places) and k < len(places) and places[k] < last

        return all(stands(self.told.get(w)) for w in set(template.telling)) and any(stands(self.where.get(w)) for w in template.needed)

    def gain(self, template: Template, first: int, last: int) -> float:
        body = " ".join(self.words[first:last]).encode()
        key = (id(template), body)
        if key not in self.gains:
            if len(self.gains) >= self.HELD:
                self.gains.clear()
            self.gains[key] = template.gain(body, _plain(body))
        return self.gains[key]

    def differences(self, template: Template, block: list[str]) -> tuple[int, int, int, int]:
        key = (id(template), " ".join(block).encode())
        if key not in self.compared:
            if len(self.compared) >= self.HELD:
                self.compared.clear()
            self.compared[key] = template.differences(block)
        return self.compared[key]

    def denied(self, first: int) -> bool:
        """Whether the words before the one that a notice begins with say that it does not hold."""
        within, whole = 0, True
        while first - within not in self.opens and within < _NONE_WITHIN:
            whole = whole and first - within not in self.parts
            within += 1
            word = self.words[first - within]
            if (word in _DENIED and within <= _DENIED_WITHIN) or (word in _NONE and whole):
                return True
        return False


def _order(found: Found) -> tuple[int, float]:
    return found.missing + found.added, -found.gain


def _winners(places: dict[tuple[int, int, str], Found]) -> Iterator[Found]:
    """Places that no longer place of another license overlaps."""
    held: list[tuple[int, int, str]] = []  # by first word; those of one license may overlap
    reach = 0
    for (first, end, name), found in sorted(places.items(), key=lambda p: (p[0][0], -p[0][1])):
        if first >= reach:
            yield from _longest(held, places)
            held = []
        held.append((first, end, name))
        reach = max(reach, end)
    yield from _longest(held, places)


def _longest(held: list[tuple[int, int, str]], places: dict[tuple[int, int, str], Found]) -> Iterator[Found]:
    def rank(place: tuple[int, int, str]) -> tuple[int, tuple[int, float]]:
        found = places[place]
        return found.added - (place[1] - place[0]), _order(found)

    kept: list[tuple[int, int, str]] = []
    for place in sorted(held, key=rank):
        if all(place[2] == k[2] or place[1] <= k[0] or k[1] <= place[0] for k in kept):
            kept.append(place)
            yield places[place]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row a document: doc_id, licenses (array of license, gain, missing, added), by name.

    Null and empty texts have none.  Texts without a word of licensing never leave the JVM.  Ties
    between wordings of one license go to the greater gain.  Notices that are denied ("not licensed
    under") are none.  Very long texts are scanned whole, repeated rows alike, and an empty table gives
    no rows.  Columns other than the two named are not read, so their names cannot clash.
    """
    fields = [("license", pa.string()), ("gain", pa.float64()), ("missing", pa.int32()), ("added", pa.int32())]

    @F.arrow_udf("array<struct<license:string,gain:double,missing:int,added:int>>")
    def scan(texts: pa.Array) -> pa.Array:
        scanner = Scanner(templates)
        return pa.array([[vars(f) for f in scanner.scan(t.as_py())] for t in texts], pa.list_(pa.struct(fields)))

    text = F.col(text_col)
    hit = F.when(text.rlike(ANCHOR), text)
    return docs.select(F.col(id_col).alias("doc_id"), scan(hit).alias("licenses"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, the licenses by name, how many, and the words that differ in all."""
    found = scan_licenses(docs, **options)
    names = F.transform("licenses", lambda x: x["license"])
    changed = F.aggregate("licenses", F.lit(0), lambda s, x: s + x["missing"] + x["added"])
    return found.select(
        "doc_id",
        F.array_join(names, ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
        changed.cast("long").alias("n_changed_words"),
    )
