"""Operator 10: license scan by ordered signature rules.

Rules are regular expressions over a text's words (A-Z lower-cased, parted by single spaces). A rule runs only where
all its keywords occur. Detections are ranked by priority and length; one that lies inside a better one is
suppressed. Three fixed phrases form the base; their labels always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import read_table, words_of

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label stem: (pattern of the name's words, keyword, versions); a version becomes part of the label.
FAMILIES = {
    "mit": (r"(?:mit|expat)", "mit", ()),
    "isc": (r"isc", "isc", ()),
    "zlib": (r"zlib(?: libpng)?", "zlib", ()),
    "apache": (r"apache(?: software)?", "apache", ("1.0", "1.1", "2")),
    "gpl": (r"(?:gnu )?(?:general public|gpl)", "gpl|general public", ("1", "2", "3")),
    "lgpl": (r"(?:gnu )?(?:lesser|library) (?:general public|gpl)|lgpl", "lgpl|lesser|library", ("2", "2.1", "3")),
    "agpl": (r"(?:gnu )?affero (?:general public|gpl)|agpl", "agpl|affero", ("1", "3")),
    "mpl": (r"(?:mozilla public|mpl)", "mpl|mozilla", ("1.0", "1.1", "2")),
    "epl": (r"(?:eclipse public|epl)", "epl|eclipse", ("1.0", "2")),
    "cddl": (r"(?:common development and distribution|cddl)", "cddl|common development", ("1.0", "1.1")),
    "bsd-2-clause": (r"(?:bsd 2 clause|simplified bsd|freebsd)", "bsd", ()),
    "bsd-3-clause": (r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd)", "bsd", ()),
    "bsd-4-clause": (r"(?:bsd 4 clause|original bsd)", "bsd", ()),
    "bsd": (r"bsd", "bsd", ()),
    "boost": (r"boost(?: software)?", "boost", ("1.0",)),
    "artistic": (r"artistic", "artistic", ("1.0", "2")),
    "unlicense": (r"unlicen[sc]e", "unlicen", ()),
    "wtfpl": (r"(?:wtfpl|do what the fuck you want to public)", "wtfpl|do what the", ()),
    "eupl": (r"(?:european union public|eupl)", "eupl|european union", ("1.1", "1.2")),
    "ofl": (r"(?:sil )?open font|ofl", "ofl|open font", ("1.1",)),
    "odbl": (r"(?:open (?:data commons )?open database|open database|odbl)", "odbl|open d", ("1.0",)),
    "gfdl": (r"(?:gnu )?free documentation|gfdl", "gfdl|free documentation", ("1.2", "1.3")),
    "postgresql": (r"postgresql", "postgresql", ()),
    "psf": (r"(?:python software foundation|psf)", "psf|python software", ("2",)),
    "php": (r"php", "php", ("3.0", "3.01")),
    "ms-pl": (r"(?:microsoft public|ms pl)", "ms pl|microsoft public", ()),
    "osl": (r"(?:open software|osl)", "osl|open software", ("2.1", "3.0")),
    "afl": (r"(?:academic free|afl)", "afl|academic free", ("2.1", "3.0")),
    "cecill": (r"cecill", "cecill", ("1.0", "2", "2.1")),
    "upl": (r"(?:universal permissive|upl)", "upl|universal permissive", ("1.0",)),
    "ncsa": (r"(?:university of illinois|ncsa)", "ncsa|university of illinois", ()),
    "bsl": (r"(?:business source|busl)", "busl|business source", ("1.1",)),
    "sspl": (r"(?:server side public|sspl)", "sspl|server side public", ("1",)),
    "elastic": (r"elastic", "elastic", ("2",)),
    "openrail": (r"(?:creativeml )?open ?rail m?", "rail", ()),
    "llama": (r"llama(?: \d)? community", "llama", ()),
}
#: Families whose short name means nothing but the license, so that it and a version need no word for license by them.
ACRONYMS = ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "odbl", "gfdl", "sspl")
#: Short names of licenses as two of them are offered together.
OFFERED = r"(?:mit|expat|isc|zlib|apache|bsd|gpl|lgpl|agpl|mpl|epl|cddl|eupl|artistic|unlicense|gnu|mozilla|eclipse|boost|ruby|commercial|proprietary|\w*gplv?\d)"
CREATIVE = {
    "by": ("by", "attribution"),
    "by-sa": ("by sa", "attribution sharealike"),
    "by-nc": ("by nc", "attribution noncommercial"),
    "by-nd": ("by nd", "attribution noderivatives"),
    "by-nc-sa": ("by nc sa", "attribution noncommercial sharealike"),
    "by-nc-nd": ("by nc nd", "attribution noncommercial noderivatives"),
}
#: Phrases of full notices and other marks: (label, pattern, keyword).
NOTICES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose", "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public", "redistribute"),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", "as is"),
    ("unlicense", r"free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|in ?to|to) the public domain", "public domain"),
    ("cc0", r"(?:cc0|cc zero)(?: 1 0)?(?: universal)?", "cc"),
    ("cc0", r"creativecommons org publicdomain zero 1 0", "publicdomain"),
    ("proprietary", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("no-derivatives", r"no derivative works?", "derivative"),
    ("copyright", r"copyright(?: c)? (?:19|20)\d\d", "copyright"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial portions"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", "to do so the software"),
    ("mit-modern", r"permission is hereby granted without written agreement and without license or royalty fees", "without written agreement"),
    ("x11", r"except as contained in this notice the names? of (?:\w+ ){1,8}shall not be used in advertising", "except as contained in this notice"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", "and its documentation"),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", "appear in all copies"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", "hereby granted the software"),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice this list of conditions", "redistributions of source"),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd-3-clause", r"neither the names? of (?:\w+ ){1,12}may be used to endorse or promote products", "endorse or promote"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "all advertising materials"),
    ("bsd-3-clause-clear", r"no express or implied licen[sc]es to any party s patent rights are granted", "patent rights are granted"),
    ("bsd-1-clause", r"redistributions of source code must retain the above copyright notice this condition", "this condition"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original", "plainly marked"),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented"),
    ("libpng", r"the png reference library is supplied as is", "png reference library"),
    ("apache-2", r"you may not use this file except in compliance with the license", "except in compliance"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license", "required by applicable law"),
    ("apache-2", r"see the license for the specific language governing permissions and limitations under the license", "governing permissions"),
    ("apache-1.1", r"the end user documentation included with the redistribution if any must include the following acknowledg", "end user documentation"),
    ("apache-1.0", r"this software consists of voluntary contributions made by many individuals on behalf of the apache", "voluntary contributions"),
    ("gpl", r"you should have received a copy of the gnu general public license along with", "received a copy of the gnu general"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "see the gnu general"),
    ("gpl-2", r"either version 2 of the license or at your option any later version", "either version 2 of the"),
    ("gpl-3", r"either version 3 of the license or at your option any later version", "either version 3 of the"),
    ("gpl-2", r"gnu general public license as published by the free software foundation either version 2", "foundation either version 2"),
    ("gpl-2", r"gnu general public license version 2 as published by the free software foundation", "version 2 as published"),
    ("gpl-3", r"gnu general public license version 3 as published by the free software foundation", "version 3 as published"),
    ("gpl", r"this program comes with absolutely no warranty", "absolutely no warranty"),
    ("lgpl", r"terms of the gnu (?:lesser|library) general public license", "gnu lesser general|gnu library general"),
    ("lgpl-2.1", r"either version 2 1 of the license or at your option any later version", "either version 2 1"),
    ("lgpl", r"the licenses for most software are designed to take away your freedom", "take away your freedom"),
    ("agpl", r"terms of the gnu affero general public license", "gnu affero"),
    ("agpl", r"interacting with it remotely through a computer network", "remotely through a computer network"),
    ("gpl-classpath", r"linking this (?:library|code) statically or dynamically with other modules", "statically or dynamically"),
    ("gcc-exception", r"gcc runtime library exception", "runtime library exception"),
    ("bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "parser skeleton"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form"),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file", "copy of the mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "contents of this file"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0", "contents of this file"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "contents of this file"),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public license", "accompanying program"),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", "accompanying materials"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", "accompanying materials"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", "accompanying program"),
    ("ipl-1.0", r"the accompanying program is provided under the terms of this ibm public license", "accompanying program"),
    ("boost-1.0", r"boost software license version 1 0 august 17th 2003", "august 17th 2003"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "intent of this document"),
    ("artistic-2", r"everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim copies of this license"),
    ("perl", r"this (?:library|program|module|package) is free software you can redistribute it and or modify it under the same terms as perl itself", "same terms as perl"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "associated a work with this deed"),
    ("cc0", r"to the extent possible under law (?:\w+ ){1,12}has waived all copyright and related or neighboring rights", "waived all copyright"),
    ("public-domain", r"the authors? disclaims? copyright to this source code", "copyright to this source"),
    ("public-domain", r"this (?:work|file|software|code) (?:is|was|has been) (?:placed )?in the public domain", "in the public domain"),
    ("public-domain", r"no copyright is claimed", "no copyright is claimed"),
    ("blessing", r"may you do good and not evil", "good and not evil"),
    ("json", r"the software shall be used for good not evil", "for good not evil"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified copies"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "retain this notice"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "this font software"),
    ("ofl-1.1", r"with reserved font names?", "reserved font name"),
    ("ofl-1.1", r"the font software may be sold as part of a larger software package", "font software"),
    ("bitstream-vera", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license", "fonts accompanying this license"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation license"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "eric young"),
    ("psf-2", r"this license agreement is between the python software foundation", "between the python software"),
    ("cnri-python", r"this license agreement is between the corporation for national research initiatives", "national research initiatives"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim copies"),
    ("php-3.01", r"this product includes php software freely available from", "includes php software"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "fee is hereby granted provided"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", "documentation for any purpose with"),
    ("icu", r"unicode inc license agreement data files and software", "unicode inc license"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files"),
    ("w3c", r"this work is being provided by the copyright holders under the following license", "being provided by the copyright holders"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "without a written agreement"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "copies of vim"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software", "authors hereby grant permission"),
    ("ncsa", r"developed by (?:\w+ ){1,8}university of illinois permission is hereby granted", "university of illinois"),
    ("ecl-2", r"educational community license version 2 0", "educational community"),
    ("afl-3.0", r"licensed under the academic free license version 3 0", "academic free"),
    ("osl-3.0", r"licensed under the open software license version 3 0", "open software"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "accompanying software"),
    ("eupl-1.2", r"licen[sc]ed under the eupl (?:version |v )?1 2", "eupl"),
    ("cecill", r"ce logiciel est r(?:é|e)gi par la licence cecill", "licence cecill"),
    ("cecill", r"this software is governed by the cecill (?:\w )?license under french law", "governed by the cecill"),
    ("odbl-1.0", r"this (?:\w+ ){1,6}is made available under the open database license", "open database"),
    ("odc-by-1.0", r"is made available under the open data commons attribution license", "open data commons attribution"),
    ("pddl-1.0", r"is made available under the public domain dedication and license", "public domain dedication"),
    ("ogl-uk", r"contains public sector information licensed under the open government licen[sc]e", "open government"),
    ("ogl-wotc", r"open game license version 1 0a", "open game license"),
    ("cdla", r"community data license agreement (?:permissive|sharing)", "community data license"),
    ("openrail", r"use restrictions as referenced in paragraph 5", "use restrictions as referenced"),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("bsl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production use"),
    ("commons-clause", r"the software is provided to you by the licensor under the license as defined below subject to the following condition", "defined below subject"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license", "polyform"),
    ("non-commercial", r"for non ?commercial (?:use|purposes) only", "commercial"),
    ("non-commercial", r"may not be used for commercial purposes", "commercial purposes"),
    ("research-only", r"licensed for (?:academic|research)(?: and (?:academic|research))? (?:use|purposes) only", "licensed for"),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying"),
    ("proprietary", r"may not be reproduced (?:distributed )?(?:or transmitted )?in any form (?:or by any means )?without (?:the )?(?:prior )?(?:written )?permission of the copyright", "may not be reproduced"),
    ("proprietary", r"this software is the confidential and proprietary information of", "confidential and proprietary"),
    ("eula", r"this end user license agreement is a legal agreement between you", "end user license"),
    ("dual", rf"dual licensed under (?:(?:the|a|either|both) )*{OFFERED} (?:\w+ ){{0,6}}(?:and|or) (?:(?:the|a) )?{OFFERED}", "dual licensed"),
    ("same-terms", r"licensed under the same terms as", "same terms as"),
    ("third-party", r"this (?:product|software|file) (?:includes|contains) (?:software|code) (?:developed by|from|licensed under)", "includes|contains"),
]
PRIORITY = {"spdx": 6, "notice": 5, "url": 4, "versioned": 3, "licensed": 2, "named": 1}
WEIGHT = {"spdx": 0.95, "notice": 0.9, "url": 0.85, "versioned": 0.9, "licensed": 0.7, "named": 0.5, "base": 0.9}


class Rule(NamedTuple):
    label: str
    kind: str
    keywords: tuple[tuple[str, ...], ...]  # one of each must occur
    pattern: re.Pattern


def word_pattern(body: str) -> re.Pattern:
    return re.compile(rf"(?<= )(?:{body})(?= )")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: every family by each of its versions in each way of naming it, then notices."""
    out = []

    def add(label: str, kind: str, body: str, *keywords: str) -> None:
        out.append(Rule(label, kind, tuple(tuple(k.split("|")) for k in keywords), word_pattern(body)))

    for stem, (name, keyword, versions) in FAMILIES.items():
        short = stem.replace("-", " ")
        for v in versions:
            label, spoken = f"{stem}-{v}", re.escape(v.replace(".", " ")).replace("\\ ", " ") + ("" if "." in v else "(?: 0)?")
            add(label, "spdx", rf"spdx licen[sc]e identifier {short} {spoken}(?: only| or later)?", "spdx")
            add(label, "versioned", rf"(?:{name})(?: licen[sc]e)? (?:version |v ?)?{spoken}(?: licen[sc]e)?", keyword, "licen")
            add(label, "versioned", rf"(?:{name})(?: licen[sc]e)? v{spoken}", keyword, "licen")
            add(label, "licensed", rf"licensed under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)? (?:version |v ?)?{spoken}", "licensed", keyword)
            if stem in ACRONYMS:
                add(label, "versioned", rf"(?:gnu )?{stem}(?: version | ?v ?|){spoken}(?: only| or later)?", stem)
                add(label, "versioned", rf"(?:gnu )?{stem} {spoken} (?:only|or later)", stem)
            first = short.split()[0]
            add(label, "url", rf"{first} org licen[sc]es? (?:licen[sc]e )?{spoken}(?: txt| html)?", first, " org ")
            add(label, "url", rf"(?:gnu|opensource|spdx|eclipse|mozilla) org licen[sc]es? (?:old licen[sc]es )?{short} {spoken}(?: txt| html)?", first, " org ")
        add(stem, "spdx", rf"spdx licen[sc]e identifier {short}", "spdx")
        add(stem, "licensed", rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)?", "under", keyword)
        add(stem, "named", rf"(?:{name}) licen[sc]e", keyword, "licen")
        add(stem, "url", rf"opensource org licen[sc]es? {short}(?: licen[sc]e)?(?: php| html)?", "opensource")
    for part, (short, long) in CREATIVE.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spoken = v.replace(".", " ")
            add(f"cc-{part}-{v}", "versioned", rf"cc {short} {spoken}", "cc by")
            add(f"cc-{part}-{v}", "versioned", rf"creative commons {long} {spoken}", "creative commons")
            add(f"cc-{part}-{v}", "url", rf"creativecommons org licenses {short} {spoken}", "creativecommons")
        add(f"cc-{part}", "named", rf"cc {short}", "cc by")
        add(f"cc-{part}", "named", rf"creative commons {long}", "creative commons")
    for label, body, keyword in NOTICES:
        add(label, "notice", body, keyword)
    return tuple(out)


@cache
def by_keyword() -> tuple[tuple[str, ...], dict[str, list[int]]]:
    """All keywords of all rules; the rules that each can open, that is, which have it in their first set."""
    opened: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r.keywords[0]:
            opened.setdefault(k, []).append(i)
    return tuple(sorted({k for r in rules() for ks in r.keywords for k in ks})), opened


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, stop, priority, rule), those not inside a better one, of any label: higher priority, longer, or the earlier rule.

    A tree of largest stops over the starts tells in log n steps whether one kept so far begins no later and ends no sooner.
    """
    rank = {x: i + 1 for i, x in enumerate(sorted({d[0] for d in found}))}
    tree, kept = [0] * (len(rank) + 1), []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[3], d[0])):
        i, most = rank[d[0]], 0
        while i:
            most, i = max(most, tree[i]), i & (i - 1)
        if most >= d[1]:
            continue
        i = rank[d[0]]
        while i < len(tree):
            tree[i] = max(tree[i], d[1])
            i += i & -i
        kept.append(d)
    return sorted(kept)


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, str]], float]:
    """Words; base places (word, label); kept detections (first word, words, label, kind); score in 0..1."""
    words = words_of(text)
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    base = []
    for phrase, label in BASE.items():
        at = line.find(f" {phrase} ")
        while at >= 0:
            base.append((at, label))
            at = line.find(f" {phrase} ", at + 1)
    found, (keywords, opened) = [], by_keyword()
    present = {k for k in keywords if k in line}
    for i in sorted({i for k in present for i in opened.get(k, ())}):
        r = rules()[i]
        if not any(present.isdisjoint(ks) for ks in r.keywords):
            found += [(m.start(), m.end(), PRIORITY[r.kind], i) for m in r.pattern.finditer(line)]
    spans, miss = [], 1.0
    spaces = list(accumulate((c == " " for c in line), initial=0)) if base or found else []
    base = [(spaces[at], label) for at, label in base]
    for start, stop, _, i in suppress(found):
        r = rules()[i]
        spans.append((spaces[start] - 1, spaces[stop] - spaces[start] + 1, r.label, r.kind))
        miss *= 1 - WEIGHT[r.kind]
    for _ in base:
        miss *= 1 - WEIGHT["base"]
    return len(words), sorted(base), spans, round(1 - miss, 6)


SPANS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("kind", pa.string())]))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", with_spans: bool = False) -> DataFrame:
    """License detections of every whole text; with ``with_spans`` also each kept span.

    Null and empty texts have no words, no places, empty label strings and score 0. One row out for each row in;
    other columns aren't read. A map over the rows, so any size of group or source is dealt out evenly.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for t in b.column("text").to_pylist():
                n, base, spans, score = scan(t)
                own = sorted({label for _, label in base})
                every = sorted({*own, *(s[2] for s in spans)})
                places = [w for w, _ in base]
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(own), ",".join(every), score))
                found.append([{"word": s[0], "words": s[1], "label": s[2], "kind": s[3]} for s in spans])
            cols = list(zip(*rows)) or [()] * 7
            out = [b.column("key"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]))]
            names = ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            if with_spans:
                out.append(pa.array(found, SPANS))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"key {kind}, {SCHEMA}" + ", spans array<struct<word:long,words:long,label:string,kind:string>>" * with_spans
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of ``documents``, one row each."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
