"""License scan by ordered signature rules (operator 3).

Rules are signatures, written by hand from the licenses' own words (bodies, headers, notices, addresses), and mentions:
the licenses' names, also by hand, in phrases that grant them. Each has a label, a regex over the text with A-Z
lower-cased, literal keywords that every match contains, and a priority. A rule runs only on texts that hold its
keywords. Detections that overlap are resolved in priority order (higher first, then longer, then earlier, then
rule order): one that lies within the interval of an accepted detection is suppressed, by a sweep over the accepted
intervals that no other contains. What stays gives the labels.

The base phrases (word sequences, whatever separates the words) are rules too, at the top priority, and are never
suppressed. Word positions count words of the whole text from 0.

Nulls and empty texts: no words, no places, empty label strings, score 0. A phrase that occurs twice counts twice.
Repeated rows each get their row. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, UPPER, WORD, WORD_BYTES, slices

#: Fixed by the query's contract: phrase and label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, keyword, words of the license itself (blanks stand for any separators): bodies, headers, notices, addresses.
SIGNATURES = [
    ("mit", "permission", "permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice", "the above copyright notice and this permission notice(?: \\(including the next paragraph\\))? shall be included in all copies or substantial portions of the software"),
    ("mit", "to deal in the", "to deal in the software without restriction,? including without limitation the rights to use,? copy,? modify,? merge,? publish,? distribute"),
    ("mit", "opensource.org", "opensource\\.org/licenses/mit"),
    ("mit-0", "mit no attribution", "mit no attribution"),
    ("x11", "except as contained", "except as contained in this notice,? the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use", "permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "opensource.org", "opensource\\.org/licenses/isc"),
    ("0bsd", "clause", "bsd zero[ -]clause license"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", "neither the name of [^.]{1,120}? nor the names of (?:its|any) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "opensource.org", "opensource\\.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", "opensource.org", "opensource\\.org/licenses/bsd-2-clause"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "governed", "governed by a bsd[ -]style license that can be found in the license file"),
    ("apache-2", "apache license", "licensed under the apache license,? version 2\\.0 \\(the .{0,8}license.{0,8}\\)"),
    ("apache-2", "except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", "apache.org", "apache\\.org/licenses/license-2\\.0"),
    ("apache-2", "january 2004", "apache license,? version 2\\.0,? january 2004"),
    ("apache-2", "unless required by", "unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an"),
    ("apache-2", "contributor license", "licensed to the apache software foundation \\(asf\\) under one or more contributor license agreements"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1", "apache group", "this product includes software developed by the apache group"),
    ("gpl", "free software", "this (?:program|library|file|software) is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", "general public license", "you should have received a copy of the gnu general public license"),
    ("gpl", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document,? but changing it is not allowed"),
    ("gpl-2", "june 1991", "gnu general public license,? version 2,? june 1991"),
    ("gpl-3", "june 2007", "gnu general public license,? version 3,? 29 june 2007"),
    ("gpl-2", "general public license", "gnu general public license,? version 2(?:\\.0)? only"),
    ("gpl-2-or-later", "later version", "gnu general public license as published by the free software foundation[;,]? either version 2 of the license,? or \\(at your option\\) any later version"),
    ("gpl-3-or-later", "later version", "gnu general public license as published by the free software foundation[;,]? either version 3 of the license,? or \\(at your option\\) any later version"),
    ("gpl-2", "gnu.org", "gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0"),
    ("gpl-3", "gnu.org", "gnu\\.org/licenses/gpl-3\\.0"),
    ("lgpl", "lesser general public", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "library general public", "under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license,? version 2\\.1,? february 1999"),
    ("lgpl-2", "library general public", "gnu library general public license,? version 2"),
    ("lgpl-2.1", "gnu.org", "gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1"),
    ("lgpl-3", "gnu.org", "gnu\\.org/licenses/lgpl-3\\.0"),
    ("agpl-3", "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3", "november 2007", "gnu affero general public license,? version 3,? 19 november 2007"),
    ("agpl-3", "gnu.org", "gnu\\.org/licenses/agpl-3\\.0"),
    ("gfdl", "free documentation", "permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "free documentation", "gnu free documentation license"),
    ("classpath-exception", "special exception", "as a special exception,? the copyright holders of this library give you permission to link this library with independent modules"),
    ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public license,? v\\. ?2\\.0"),
    ("mpl-2", "mpl was not", "if a copy of the mpl was not distributed with this file,? you can obtain one at"),
    ("mpl-2", "mozilla.org", "mozilla\\.org/(?:en-us/)?mpl/2\\.0"),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1\\.1"),
    ("npl-1.1", "netscape public", "the contents of this file are subject to the netscape public license"),
    ("epl-1", "eclipse public", "made available under the terms of the eclipse public license v(?:ersion )?1\\.0"),
    ("epl-2", "eclipse public", "made available under the terms of the eclipse public license (?:v|version )?2\\.0"),
    ("epl-1", "eclipse.org", "eclipse\\.org/legal/epl-v10"),
    ("epl-2", "eclipse.org", "eclipse\\.org/legal/epl-(?:v20|2\\.0)"),
    ("edl-1", "eclipse distribution", "eclipse distribution license v(?:ersion )?\\. ?1\\.0"),
    ("cddl-1", "development and distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", "common public license", "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1", "ibm public license", "the accompanying program is provided under the terms of this ibm public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", "anyone is free to copy,? modify,? publish,? use,? compile,? sell,? or distribute this software"),
    ("unlicense", "unlicense.org", "unlicense\\.org"),
    ("public-domain", "public domain", "(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "this (?:file|work|code|software|document) is in the public domain"),
    ("cc0", "publicdomain", "creativecommons\\.org/publicdomain/zero/1\\.0"),
    ("cc0", "waived all", "has waived all copyright and related or neighbou?ring rights"),
    ("cc0", "cc0", "cc0 1\\.0 universal"),
    ("cc-pdm", "publicdomain", "creativecommons\\.org/publicdomain/mark/1\\.0"),
    ("cc-by", "creativecommons", "creativecommons\\.org/licenses/by/[1-4]\\.[05]"),
    ("cc-by-sa", "creativecommons", "creativecommons\\.org/licenses/by-sa/[1-4]\\.[05]"),
    ("cc-by-nd", "creativecommons", "creativecommons\\.org/licenses/by-nd/[1-4]\\.[05]"),
    ("cc-by-nc", "creativecommons", "creativecommons\\.org/licenses/by-nc/[1-4]\\.[05]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons\\.org/licenses/by-nc-sa/[1-4]\\.[05]"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons\\.org/licenses/by-nc-nd/[1-4]\\.[05]"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution[ -]non[ -]?commercial[ -]share[ -]?alike"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution[ -]non[ -]?commercial[ -]no[ -]?deriv[a-z]*"),
    ("zlib", "express or implied", "this software is provided .{0,3}as[ -]is.{0,3},? without any express or implied warranty"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such,? and must not be misrepresented as being the original software"),
    ("zlib", "origin of this", "the origin of this software must not be misrepresented"),
    ("libpng", "png", "the png reference library is supplied .as is."),
    ("boost-1", "boost software license", "boost software license - version 1\\.0 - august 17th,? 2003"),
    ("boost-1", "boost software license", "distributed under the boost software license,? version 1\\.0"),
    ("boost-1", "boost.org", "boost\\.org/license_1_0\\.txt"),
    ("wtfpl", "what the fuck", "you just do what the fuck you want to"),
    ("beerware", "whatever", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("artistic-1", "conditions under", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "artistic license", "artistic license 2\\.0"),
    ("perl", "perl itself", "(?:under the )?same terms as perl(?: 5)? itself"),
    ("ruby", "ruby", "distributed under the same terms as ruby"),
    ("php-3.01", "php license", "this source file is subject to version 3\\.01 of the php license"),
    ("python-2", "python software foundation", "python software foundation license version 2"),
    ("python-2", "agreement", "this license agreement is between the python software foundation"),
    ("postgresql", "written agreement", "permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee,? and without a written agreement"),
    ("hpnd", "documentation", "permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("curl", "daniel stenberg", "copyright \\(c\\) [0-9 ,-]{4,20}daniel stenberg"),
    ("ofl-1.1", "open font license", "this font software is licensed under the sil open font license,? version 1\\.1"),
    ("ofl-1.1", "scripts.sil.org", "scripts\\.sil\\.org/ofl"),
    ("ms-pl", "microsoft public", "microsoft public license \\(ms-pl\\)"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license \\(ms-rl\\)"),
    ("eupl-1.2", "eupl", "licensed under the eupl,? version 1\\.2"),
    ("odbl-1", "open database license", "made available under the open database license"),
    ("pddl-1", "public domain dedication", "open data commons public domain dedication (?:and|&) licen[cs]e"),
    ("odc-by-1", "open data commons", "open data commons attribution license"),
    ("ogl-uk-3", "open government", "open government licen[cs]e v?(?:ersion )?3\\.0"),
    ("unicode", "unicode", "unicode,? inc\\. license agreement"),
    ("w3c", "w3c", "w3c software notice and license"),
    ("ncsa", "university of illinois", "university of illinois/ncsa open source license"),
    ("sspl-1", "server side public", "server side public license"),
    ("busl-1.1", "business source", "business source license 1\\.1"),
    ("elastic-2", "elastic license", "elastic license 2\\.0"),
    ("commons-clause", "commons clause", "commons clause. license condition v1\\.0"),
    ("jsr-json", "evil", "the software shall be used for good,? not evil"),
    ("llama-2", "llama", "llama 2 community license agreement"),
    ("openrail-m", "openrail", "(?:creativeml |bigscience |bigcode )?openrail-?m(?:\\+\\+)?(?: license)?"),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file,? via any medium,? is strictly prohibited"),
    ("proprietary", "may not be reproduced", "may not be reproduced,? (?:stored|distributed|copied)[^.]{0,80}? without (?:the )?(?:prior )?written permission"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
#: Priority and confidence of signatures; the last one says the least.
SIGNED, RESERVED = (85, 0.95), (10, 0.3)

#: Label -> spellings of the license's name (regexes over lower-cased text, blanks stand for any separators).
FAMILIES = {
    "mit": ["mit", "mit license", "expat"],
    "apache-2": ["apache license,? version 2(?:\\.0)?", "apache[ -]2(?:\\.0)?", "apache license 2(?:\\.0)?", "asl 2\\.0"],
    "apache-1.1": ["apache software license,? version 1\\.1", "apache[ -]1\\.1"],
    "bsd-2-clause": ["bsd[ -]2[ -]clause", "2[ -]clause bsd", "simplified bsd", "freebsd"],
    "bsd-3-clause": ["bsd[ -]3[ -]clause", "3[ -]clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "bsd-4-clause": ["bsd[ -]4[ -]clause", "original bsd"],
    "isc": ["isc", "isc license"],
    "gpl-2": ["gpl ?v2", "gpl[ -]2(?:\\.0)?(?:[ -]only)?", "gnu general public license,? version 2", "gnu gpl,? version 2"],
    "gpl-3": ["gpl ?v3", "gpl[ -]3(?:\\.0)?(?:[ -]only)?", "gnu general public license,? version 3", "gnu gpl,? version 3"],
    "gpl": ["gnu general public license", "gnu gpl"],
    "lgpl-2.1": ["lgpl ?v2(?:\\.1)?", "lgpl[ -]2\\.1", "gnu lesser general public license,? version 2\\.1"],
    "lgpl-3": ["lgpl ?v3", "lgpl[ -]3(?:\\.0)?", "gnu lesser general public license,? version 3"],
    "agpl-3": ["agpl ?v3", "agpl[ -]3(?:\\.0)?", "gnu affero general public license,? version 3"],
    "mpl-2": ["mozilla public license,? version 2(?:\\.0)?", "mpl[ -]2(?:\\.0)?", "mpl ?v2"],
    "mpl-1.1": ["mozilla public license,? version 1\\.1", "mpl[ -]1\\.1"],
    "epl-2": ["eclipse public license,? version 2(?:\\.0)?", "epl[ -]2(?:\\.0)?"],
    "epl-1": ["eclipse public license,? version 1(?:\\.0)?", "epl[ -]1(?:\\.0)?"],
    "cddl-1": ["common development and distribution license", "cddl[ -]1(?:\\.0)?"],
    "artistic-2": ["artistic license 2(?:\\.0)?", "artistic[ -]2(?:\\.0)?"],
    "zlib": ["zlib", "zlib license"],
    "unlicense": ["unlicense", "the unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "boost-1": ["boost software license", "bsl[ -]1(?:\\.0)?"],
    "postgresql": ["postgresql license", "postgresql"],
    "python-2": ["psf license", "python software foundation license"],
    "ofl-1.1": ["sil open font license", "ofl[ -]1\\.1"],
    "cc0": ["cc0(?:[ -]1\\.0)?", "creative commons zero", "public domain dedication"],
    "cc-by": ["cc[ -]by(?:[ -][1-4]\\.0)?(?![ -](?:nc|nd|sa))", "creative commons attribution(?![ -](?:non|no|share))"],
    "cc-by-sa": ["cc[ -]by[ -]sa(?:[ -][1-4]\\.0)?", "creative commons attribution[ -]share[ -]?alike"],
    "cc-by-nd": ["cc[ -]by[ -]nd(?:[ -][1-4]\\.0)?", "creative commons attribution[ -]no[ -]?deriv[a-z]*"],
    "cc-by-nc": ["cc[ -]by[ -]nc(?![ -](?:sa|nd))(?:[ -][1-4]\\.0)?", "creative commons attribution[ -]non[ -]?commercial"],
    "cc-by-nc-sa": ["cc[ -]by[ -]nc[ -]sa(?:[ -][1-4]\\.0)?"],
    "cc-by-nc-nd": ["cc[ -]by[ -]nc[ -]nd(?:[ -][1-4]\\.0)?"],
    "eupl-1.2": ["european union public licen[cs]e", "eupl[ -]1\\.2"],
    "proprietary": ["proprietary license", "commercial license"],
}
#: Template, its keywords (every match holds them all), priority, confidence. {} is the name.
TEMPLATES = [
    ("spdx[ -]license[ -]identifier ?: ?{}", ("spdx",), 90, 1.0),
    ("licensed under (?:the )?(?:terms of the )?{}", ("licensed", "under"), 80, 0.95),
    ("licenced under (?:the )?(?:terms of the )?{}", ("licenced", "under"), 80, 0.95),
    *((v + " under (?:the )?(?:terms of the )?{}", (v, "under"), 70, 0.9)
      for v in ("released", "distributed", "published", "available", "provided")),
    ("under (?:the )?(?:terms of the )?{} licen[cs]e", ("under", "licen"), 60, 0.85),
    ("licen[cs]e ?[:=] ?{}", ("licen",), 60, 0.85),
    ("{} licen[cs]e", ("licen",), 40, 0.7),
]
_RIGHT = r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = str.maketrans(UPPER, LOWER)
_WORD = re.compile(WORD)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


def _spaced(regex: str) -> str:
    """Blanks of a template stand for white space and comment marks, also across lines."""
    return regex.replace("[ -]", r"[\s\-]").replace(" ?", r"[\s]{0,3}").replace(" ", r"[\s*#/]{1,8}")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Base rules, signatures, then every family name in every template, in a fixed order."""
    out = [Rule(label, re.compile(_GAP.join(p.split()) + _RIGHT), tuple(p.split()), 100, 1.0, True)
           for p, label in BASE.items()]
    for label, keyword, regex in SIGNATURES:
        rank, sure = RESERVED if label == "all-rights-reserved" else SIGNED
        out.append(Rule(label, re.compile(_spaced(regex) + _RIGHT), tuple(keyword.split()), rank, sure))
    for template, keywords, priority, confidence in TEMPLATES:
        for label, names in FAMILIES.items():
            for name in names:
                if template.startswith("{}") and "licen" in name:
                    regex, rank = name, priority + 5
                else:
                    regex, rank = template.replace("{}", f"(?:{name})"), priority
                need = (*keywords, re.match(r"[a-z0-9]+", name)[0])
                out.append(Rule(label, re.compile(_spaced(regex) + _RIGHT), need, rank, confidence))
    return tuple(out)


@lru_cache(maxsize=1)
def gates() -> dict[str, list[tuple[int, Rule]]]:
    """Rules with their order by one keyword each, the longest of theirs: few are looked for in every text."""
    out: dict[str, list[tuple[int, Rule]]] = {}
    for order, rule in enumerate(rules()):
        out.setdefault(next((k for k in ("licen", "under", "licence") if k in rule.keywords), max(rule.keywords, key=len)), []).append((order, rule))
    return out


def unsuppressed(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the detections (start, end, order, rule) that lie within no accepted one; base ones all stay."""
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []  # of accepted intervals that no other contains: both starts and ends ascend
    ends: list[int] = []
    for start, end, _, rule in sorted(found, key=lambda d: (-d[3].priority, d[0] - d[1], d[0], d[2])):
        at = bisect_right(starts, start)
        inside = at > 0 and ends[at - 1] >= end
        if rule.base or not inside:
            kept.append((start, end, rule))
        if not inside:
            low, high = bisect_left(starts, start), bisect_right(ends, end)
            starts[low:high], ends[low:high] = [start], [end]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the text with A-Z lower-cased, after suppression."""
    found = []
    held: dict[str, bool] = {}

    def holds(keyword: str) -> bool:
        if keyword not in held:
            held[keyword] = keyword in text
        return held[keyword]

    for gate, own in gates().items():
        if holds(gate):
            for order, rule in own:
                if all(map(holds, rule.keywords)):
                    at = rule.pattern.search(text)
                    while at:
                        start, end = at.span()
                        if not start or not _WORD.match(text, start - 1):  # a word begins here
                            found.append((start, end, order, rule))
                        at = rule.pattern.search(text, start + 1 if rule.base else end)  # base places may overlap
    return unsuppressed(found)


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, places of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    n_words = len(raw.split())
    low = text.translate(_LOWER) if text else ""
    kept = detections(low)
    starts, base, at, seen = [], set(), 0, 0
    for start, _, rule in kept:
        if rule.base:
            seen += len(_WORD.findall(low, at, start))
            at = start
            starts.append(seen)
            base.add(rule.label)
    labels = sorted(base | {r.label for _, _, r in kept})
    miss = 1.0
    for _, _, rule in kept:
        miss *= 1 - min(rule.confidence, 0.99)
    return (
        n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(labels), round(1 - miss, 6) if kept else 0.0, ",".join(f"{r.label}:{s}:{e}" for s, e, r in kept),
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, places string"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): SCHEMA; places are label:start:end in code points. No shuffle."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [scan(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                [x.split()[0] for x in SCHEMA.split(",")],
            )

    return docs.select("doc_id", "text").mapInArrow(scanned, SCHEMA)
