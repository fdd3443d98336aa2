"""License scans: ordered signature rules behind a keyword prefilter.

Texts are scanned as words (digits, letters and all non-ASCII characters, A-Z
lower-cased).  Two layers report:

* the *base* phrases, each place where their words stand consecutively;
* the *rules*: some hundred license names, each in several forms (identifier
  line, grant, title) with its own priority and weight, the licenses' SPDX
  identifiers in identifier lines (every one of an expression, joined by OR, AND or
  WITH) and grants, short names beside "license", "licensed" or "under", and what
  stands in the licenses' own texts and notices.  A rule's detection is what its
  first group holds, or else the whole match.  An Aho-Corasick
  automaton over the rules' keywords passes once over a text; only rules whose
  keyword occurs run their regex, on the words joined by single spaces.
  Detections are taken by priority, then length; one that lies inside a kept
  detection is suppressed.

Everything happens within a row, so the scan has no shuffle; its time grows with
the text's length and, but for a logarithm, with the number of detections.

Defined results: a null text is empty (no words, no labels, score 0); rows
repeat as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, blocks, byte_table, map_arrow, text_buffer

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

WORD_BYTES = byte_table(np.r_[48:58, 65:91, 97:123, 128:256])

#: label | keyword that any text of it has | the name in words, as a regex. Hand-written, most specific first.
NAMES = """
agpl-3.0 | affero | (?:gnu )?affero general public license(?: version)? v? ?3(?: 0)?
agpl-1.0 | affero | affero general public license(?: version)? v? ?1(?: 0)?
agpl | affero | (?:gnu )?affero general public license
agpl-3.0 | agpl | (?:gnu )?agpl(?: version)? ?v? ?3(?: 0)?
lgpl-3.0 | lesser | (?:gnu )?lesser general public license(?: version)? v? ?3(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public license(?: version)? v? ?2 1
lgpl | lesser | (?:gnu )?lesser general public license
lgpl-2.0 | library general | (?:gnu )?library general public license(?: version)? v? ?2(?: 0)?
lgpl-2.0 | library general | (?:gnu )?library general public license
lgpl-3.0 | lgpl | (?:gnu )?lgpl(?: version)? ?v? ?3(?: 0)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: version)? ?v? ?2 1
lgpl-2.0 | lgpl | (?:gnu )?lgpl(?: version)? ?v? ?2 0
gpl-3.0 | general public | (?:gnu )?general public license(?: version)? v? ?3(?: 0)?
gpl-2.0 | general public | (?:gnu )?general public license(?: version)? v? ?2(?: 0)?
gpl-1.0 | general public | (?:gnu )?general public license(?: version)? v? ?1(?: 0)?
gpl | general public | gnu general public license
gpl-3.0 | gpl | (?:gnu )?gpl(?: version)? ?v? ?3(?: 0)?
gpl-2.0 | gpl | (?:gnu )?gpl(?: version)? ?v? ?2(?: 0)?
gpl | gpl | gnu gpl
gfdl-1.3 | free documentation | (?:gnu )?free documentation license(?: version)? 1 3
gfdl-1.2 | free documentation | (?:gnu )?free documentation license(?: version)? 1 2
gfdl | free documentation | (?:gnu )?free documentation license
apache-2.0 | apache | apache (?:software )?license(?: version)? v? ?2(?: 0)?
apache-1.1 | apache | apache (?:software )?license(?: version)? v? ?1 1
apache-1.0 | apache | apache (?:software )?license(?: version)? v? ?1 0
apache-2.0 | apache | apache ?v?2(?: 0)? licensed?
apache | apache | apache (?:software )?license
mit-0 | no attribution | mit no attribution(?: license)?
mit | mit | mit license
x11 | x11 | x11 license
expat | expat | expat license
isc | isc | isc license
mit | mit | mit expat license
mit | mit | expat mit license
mit | mit | mit x11 license
mit | mit | x11 mit license
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?
bsd-0-clause | bsd | (?:0bsd|zero clause bsd)(?: license)?
bsd | bsd | bsd license
mpl-2.0 | mozilla | mozilla public license(?: version)? v? ?2(?: 0)?
mpl-1.1 | mozilla | mozilla public license(?: version)? v? ?1 1
mpl-1.0 | mozilla | mozilla public license(?: version)? v? ?1 0
mpl-2.0 | mpl | mpl ?v? ?2 0
mpl-1.1 | mpl | mpl ?v? ?1 1
mpl | mozilla | mozilla public license
epl-2.0 | eclipse | eclipse public license(?: version)? v? ?2(?: 0)?
epl-1.0 | eclipse | eclipse public license(?: version)? v? ?1(?: 0)?
epl-2.0 | epl | epl ?v? ?2 0
epl-1.0 | epl | epl ?v? ?1 0
epl | eclipse | eclipse public license
edl-1.0 | eclipse | eclipse distribution license(?:(?: version)? v? ?1 0)?
cddl-1.1 | common development | common development and distribution license(?: version)? v? ?1 1
cddl-1.0 | common development | common development and distribution license
cpl-1.0 | common public | common public license(?:(?: version)? v? ?1 0)?
ipl-1.0 | ibm public | ibm public license(?:(?: version)? v? ?1 0)?
eupl-1.2 | european union | european union public licen[cs]e(?: version)? v? ?1 2
eupl-1.1 | european union | european union public licen[cs]e(?: version)? v? ?1 1
eupl | european union | european union public licen[cs]e
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons zero | creative commons zero
cc-by-nc-nd-4.0 | cc by | cc by nc nd 4(?: 0)?(?: international)?
cc-by-nc-nd-3.0 | cc by | cc by nc nd 3(?: 0)?(?: unported)?
cc-by-nc-nd | cc by | cc by nc nd
cc-by-nc-sa-4.0 | cc by | cc by nc sa 4(?: 0)?(?: international)?
cc-by-nc-sa-3.0 | cc by | cc by nc sa 3(?: 0)?(?: unported)?
cc-by-nc-sa | cc by | cc by nc sa
cc-by-nc-4.0 | cc by | cc by nc 4(?: 0)?(?: international)?
cc-by-nc-3.0 | cc by | cc by nc 3(?: 0)?(?: unported)?
cc-by-nc-2.0 | cc by | cc by nc 2(?: 0)?(?: generic)?
cc-by-nc | cc by | cc by nc
cc-by-nd-4.0 | cc by | cc by nd 4(?: 0)?(?: international)?
cc-by-nd | cc by | cc by nd
cc-by-sa-4.0 | cc by | cc by sa 4(?: 0)?(?: international)?
cc-by-sa-3.0 | cc by | cc by sa 3(?: 0)?(?: unported)?
cc-by-sa | cc by | cc by sa
cc-by-4.0 | cc by | cc by 4(?: 0)?(?: international)?
cc-by-3.0 | cc by | cc by 3(?: 0)?(?: unported)?
cc-by-nc-nd | noncommercial | creative commons attribution noncommercial noderiv(?:ative)?s?
cc-by-nc-sa | noncommercial | creative commons attribution noncommercial sharealike
cc-by-nc | noncommercial | creative commons attribution noncommercial
cc-by-sa | creative commons | creative commons attribution share ?alike
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by | creative commons | creative commons attribution
cc | creative commons | creative commons(?: license)?
odbl-1.0 | open database | open database license(?:(?: version)? v? ?1 0)?
odc-by-1.0 | open data commons | open data commons attribution license
pddl-1.0 | open data commons | open data commons public domain dedication(?: and license)?
unlicense | unlicense | unlicense
wtfpl | public license | do what the f\\w+ you want to public license
zlib | zlib | zlib (?:libpng )?license
libpng | libpng | libpng license
boost-1.0 | boost | boost software license(?:(?: version)? v? ?1 0)?
artistic-2.0 | artistic | artistic license(?: version)? v? ?2(?: 0)?
artistic-1.0 | artistic | artistic license(?: version)? v? ?1(?: 0)?
artistic | artistic | artistic license
psf-2.0 | python software | python software foundation license(?:(?: version)? v? ?2)?
php-3.01 | php | php license(?:(?: version)? v? ?3 01)?
ruby | ruby | ruby license
perl | same terms as perl | same terms as perl(?: itself)?
postgresql | postgresql | postgresql license
ncsa | ncsa | (?:university of illinois )?ncsa open source license
w3c | w3c | w3c software(?: notice and)? license
openssl | openssl | openssl license
openldap | openldap | openldap public license
sleepycat | sleepycat | sleepycat license
qpl-1.0 | q public | q public license
ofl-1.1 | open font | (?:sil )?open font license(?:(?: version)? v? ?1 1)?
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
upl-1.0 | universal permissive | universal permissive license
osl-3.0 | open software license | open software license(?:(?: version)? v? ?3 0)?
afl-3.0 | academic free | academic free license(?:(?: version)? v? ?3 0)?
bsl-1.1 | business source | business source license(?:(?: version)? v? ?1 1)?
sspl-1.0 | server side | server side public license(?:(?: version)? v? ?1)?
elastic-2.0 | elastic | elastic license(?:(?: version)? v? ?2 0)?
rail | responsible ai | (?:open )?responsible ai license
llama | community license | llama ?[0-9]* community license
ogl-3.0 | open government | open government licen[cs]e(?:(?: version)? v? ?3 0)?
public-domain | public domain | (?:dedicated to|released (?:in)?to|placed in|in) the public domain
proprietary | proprietary | proprietary and confidential
all-rights | rights reserved | all rights reserved
no-warranty | warrant | (?:without warranty of any kind|without warranties or conditions of any kind)
"""

#: Labels whose SPDX identifier is the label itself, and those with other identifiers (in words, as a regex).
SAME_IDENTIFIER = """
agpl-3.0 lgpl-3.0 lgpl-2.1 lgpl-2.0 gpl-3.0 gpl-2.0 gpl-1.0 gfdl-1.3 gfdl-1.2 apache-2.0 apache-1.1 apache-1.0 mit-0 mit x11 isc
bsd-4-clause bsd-3-clause bsd-2-clause mpl-2.0 mpl-1.1 mpl-1.0 epl-2.0 epl-1.0 cddl-1.1 cddl-1.0 cpl-1.0 eupl-1.2 eupl-1.1 cc0-1.0
cc-by-nc-nd-4.0 cc-by-nc-nd-3.0 cc-by-nc-sa-4.0 cc-by-nc-sa-3.0 cc-by-nc-4.0 cc-by-nc-3.0 cc-by-nc-2.0 cc-by-nd-4.0
cc-by-sa-4.0 cc-by-sa-3.0 cc-by-4.0 cc-by-3.0 odbl-1.0 odc-by-1.0 pddl-1.0 unlicense wtfpl zlib libpng artistic-2.0 artistic-1.0
psf-2.0 php-3.01 ruby postgresql ncsa w3c openssl sleepycat qpl-1.0 ofl-1.1 ms-pl ms-rl upl-1.0 osl-3.0 afl-3.0 sspl-1.0 elastic-2.0
"""
OTHER_IDENTIFIERS = {
    "agpl": "agpl 1 0", "gfdl": "gfdl 1 1", "bsd-0-clause": "0bsd", "ipl-1.0": "ipl 1 0", "eupl": "eupl 1 0",
    "libpng": "libpng 2 0", "boost-1.0": "bsl 1 0", "psf-2.0": "python 2 0", "openldap": "oldap 2 [0-9](?: [0-9])?",
    "bsl-1.1": "busl 1 1", "ogl-3.0": "ogl uk 3 0",
}

#: Creative Commons licenses by what they ask for, and the versions that there are of them.
CC_PARTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1.0", "2.0", "2.1", "2.5", "3.0", "4.0")
#: label -> a short name that stands for the license beside "license", "licence" or "licensed".
SHORT = {
    "mit": "mit", "bsd": "bsd", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mpl": "mpl", "epl": "epl", "isc": "isc",
    "cddl-1.0": "cddl", "eupl": "eupl", "wtfpl": "wtfpl", "zlib": "zlib", "unlicense": "unlicense", "cc0-1.0": "cc0", "expat": "expat",
}
#: Those that are no words of their own, and so stand for their license after "under" too, or even alone.
UNDER = ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl-1.0", "eupl", "wtfpl", "cc0-1.0")
ALONE = ("gpl", "lgpl", "agpl")

#: label | keyword | words of a license's own text or notice, as a regex.
BODIES = """
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial portions | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | copy modify | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd-0-clause | copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse or promote | nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | in compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | apache org | (?:https? )?www apache org licenses license 2 0
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl-3.0 | redistribute it | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-2.0 | redistribute it | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
lgpl-3.0 | redistribute it | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.1 | redistribute it | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation
lgpl-2.0 | redistribute it | you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2
agpl-3.0 | redistribute it | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license v ?2 0
mpl-1.1 | subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-2.0 | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license ?v? ?2 0
epl-1.0 | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license ?v? ?1 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1.0 | organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
cc0-1.0 | dedicated the work | has dedicated the work to the public domain by waiving
cc0-1.0 | waived all copyright | has waived all copyright and related
cc-by-4.0 | creativecommons org | creativecommons org licenses by 4 0
cc-by-sa-4.0 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons org | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org | creativecommons org licenses by nc nd 4 0
cc0-1.0 | creativecommons org | creativecommons org publicdomain zero 1 0
ofl-1.1 | reserved font name | with reserved font name
postgresql | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | deal with the software | to deal with the software without restriction
openssl | openssl project | this product includes software developed by the openssl project
"""

#: form -> (priority, weight, regex around a name)
FORMS = {
    "tag": (90, 0.99, r"spdx license identifier ({})"),
    "grant": (80, 0.95, r"(?:licensed|released|distributed|published|available|provided|covered|governed) (?:by|under) (?:the )?(?:terms of )?(?:the )?(?:{})"),
    "body": (70, 0.9, r"(?:{})"),
    "context": (60, 0.8, r"(?:(?:licen[cs]es?|licen[cs]ed)(?: is)?(?: as)?(?: under)?(?: the)? (?:{0})|(?:{0}) licen[cs]ed)"),
    "title": (50, 0.7, r"(?:{})"),
    "alone": (40, 0.5, r"(?:{})"),
}
#: Identifiers after "licensed under"; names that are words of their own are left to the forms above.
GRANT_ID = r"(?:licensed|released|distributed|published|available|provided|covered|governed) under (?:the )?(?:terms of )?(?:the )?(?:{})(?: licen[cs]e)?"
NOT_ALONE = {"ruby", "zlib", "w3c", "postgresql", "x11"}


class Rule(NamedTuple):
    label: str
    keyword: str
    priority: int
    weight: float
    pattern: str


#: What may follow an identifier ("+" is no word).
TAIL = "(?: (?:only|or later))?"


def identifiers() -> list[tuple[str, str]]:
    """Labels and the words of their SPDX identifiers, as a regex."""
    names = [(label, re.sub("[-.]", " ", label)) for label in SAME_IDENTIFIER.split()]
    names += [(f"cc-{p.replace(' ', '-')}-{v}", f"cc {p} {v.replace('.', ' ')}") for p in CC_PARTS for v in CC_VERSIONS]
    return list(dict.fromkeys([*names, *OTHER_IDENTIFIERS.items()]))


def leading() -> str:
    """What stands before an identifier in an identifier line: earlier ones of the same expression too, the longest tried first."""
    any_one = "|".join(sorted((name for _, name in identifiers()), key=len, reverse=True))
    return f"spdx license identifier (?:(?:(?:{any_one}){TAIL}|[a-z]+(?: [a-z]+)* exception(?: [0-9]+)*) (?:or|and|with) )*"


def rules() -> list[Rule]:
    """Every name in every form, and identifier lines with SPDX identifiers ("+" is no word); of names with one form's priority the earlier, more specific one wins a tie by its length."""
    out = []
    for line in NAMES.strip().splitlines():
        label, keyword, name = (x.strip() for x in line.split("|", 2))
        for priority, weight, form in (FORMS[x] for x in ("tag", "grant", "title")):
            out.append(Rule(label, re.sub(r"[^0-9a-z]+", " ", keyword), priority, weight, rf"(?<![^ ]){form.format(name)}(?![^ ])"))
    priority, weight, _ = FORMS["tag"]
    known, before = identifiers(), leading()
    for label, name in known:
        out.append(Rule(label, "spdx", priority, weight, rf"(?<![^ ]){before}((?:{name}){TAIL})(?![^ ])"))
    priority, weight, form = FORMS["context"]
    for label, name in SHORT.items():
        out.append(Rule(label, "licen", priority, weight, rf"(?<![^ ]){form.format(name)}(?![^ ])"))
        if label in UNDER:
            out.append(Rule(label, name, priority, weight, rf"(?<![^ ])under (?:the )?(?:{name})(?![^ ])"))
        if label in ALONE:
            low, little, bare = FORMS["alone"]
            out.append(Rule(label, name, low, little, rf"(?<![^ ]){bare.format(name)}(?![^ ])"))
    priority, weight, form = FORMS["title"]
    for p in CC_PARTS:
        for v in CC_VERSIONS:
            label = f"cc-{p.replace(' ', '-')}-{v}"
            spelled = {"sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}
            full = " ".join(["creative commons attribution", *(spelled[x] for x in p.split()[1:])])
            out.append(Rule(label, "creative commons", priority, weight, rf"(?<![^ ])(?:{full} {v.replace('.', ' ')})(?![^ ])"))
            if not re.search(rf"^{re.escape(label)} ", NAMES, re.M):
                out.append(Rule(label, "cc by", priority, weight, rf"(?<![^ ])(?:cc {p} {v.replace('.', ' ')})(?![^ ])"))
    priority, weight, _ = FORMS["grant"]
    for label, name in known:
        if label not in NOT_ALONE:
            out.append(Rule(label, re.match(r"[a-z0-9 ]*[a-z0-9]", name)[0], priority, weight, rf"(?<![^ ]){GRANT_ID.format(name)}(?![^ ])"))
    priority, weight, form = FORMS["body"]
    for line in BODIES.strip().splitlines():
        label, keyword, body = (x.strip() for x in line.split("|", 2))
        out.append(Rule(label, keyword, priority, weight, rf"(?<![^ ]){form.format(body)}(?![^ ])"))
    return out


CC_BY = re.compile(rb"cc[^0-9a-z\x80-\xff]+by")


def _head(rule: Rule) -> str:
    """What any match holds: "licen" if that isn't optional, else the keyword's longest word (texts for "cc by" have a test of their own)."""
    pattern, last = rule.pattern, ""
    while pattern != last:
        pattern, last = re.sub(r"\(\?:[^()]*\)\?", "", pattern), pattern
    if "licen" in re.sub(r"spdx license|\(\?:licensed[^()]*\)", "", pattern) and "|" not in re.sub(r"\(\?:licensed[^()]*\)|\(\?:by\|under\)", "", pattern):
        return "licen"
    return "" if rule.keyword.startswith("cc by") else max(reversed(rule.keyword.split()), key=len)


def _is_grant_id(rule: Rule) -> bool:
    return rule.priority == FORMS["grant"][0] and " under (?:the )?" in rule.pattern


def _least(heads: Iterable[str | bytes]) -> list[bytes]:
    """Those that hold none of the others, the shortest first."""
    found = {h if isinstance(h, bytes) else h.encode() for h in heads if h}
    return sorted((h for h in found if not any(o != h and o in h for o in found)), key=lambda h: (len(h), h))


class Detection(NamedTuple):
    start: int  # in words
    end: int
    label: str
    priority: int
    weight: float


class Scanner:
    def __init__(self, made: list[Rule] | None = None):
        self.rules = made if made is not None else rules()
        self.patterns = [re.compile(r.pattern) for r in self.rules]
        by: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            by.setdefault(r.keyword, []).append(i)
        self.gate = ahocorasick.Automaton()
        for keyword, which in by.items():
            self.gate.add_word(keyword, which)
        if len(by):
            self.gate.make_automaton()
        #: Byte strings of which every text with a detection holds one, so that only such texts are joined for the gate.
        self.heads = _least(_head(r) for r in self.rules if not _is_grant_id(r))
        self.granted = _least([*self.heads, *(_head(r) for r in self.rules if _is_grant_id(r))])

    def may_hold(self, text: bytes) -> bool:
        """Whether any rule can match a lower-cased text; identifiers count where "under" stands too, as they are short."""
        return any(h in text for h in (self.granted if b"under" in text else self.heads)) or bool(b"cc" in text and CC_BY.search(text))

    def detect(self, words: str) -> list[Detection]:
        """Kept detections, by start, in a text given as words joined by single spaces."""
        if not self.rules:
            return []
        run = {i for _, which in self.gate.iter(words) for i in which}
        found, gaps = [], np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32) if run else None
        for i in run:
            r = self.rules[i]
            for m in self.patterns[i].finditer(words):
                part = min(1, m.re.groups)
                start = int(np.searchsorted(gaps, m.start(part)))
                found.append(Detection(start, start + m.group(part).count(" ") + 1, r.label, r.priority, r.weight))
        return suppress(found)


def suppress(found: list[Detection]) -> list[Detection]:
    """Those not contained in one of higher rank (priority, then length, then place and label)."""
    starts = sorted({d.start for d in found})
    furthest = [-1] * (len(starts) + 1)  # a binary indexed tree over starts: the greatest end of what is kept
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        at = k = bisect_left(starts, d.start) + 1
        while k and furthest[k] < d.end:
            k -= k & -k
        if not k:  # nothing kept begins at or before it and ends at or behind it
            kept.append(d)
            while at <= len(starts):
                furthest[at] = max(furthest[at], d.end)
                at += at & -at
    return sorted(kept)


def _phrase(phrase: str) -> re.Pattern:
    word, gap = rb"0-9a-z\x80-\xff", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    return re.compile(rb"(?<![" + word + rb"])" + gap.join(w.encode() for w in phrase.split()) + rb"(?![" + word + rb"])")


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base places, labels, a score, and the kept detections as label:first_word:end_word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, phrases = Scanner(), [(_phrase(p), label) for p, label in BASE.items()]
        for batch in batches:
            ids, rows = batch.column(0), []
            data, offsets = text_buffer(batch.column(1))
            for i, j in blocks(offsets, 4 << 20):
                own = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                words = Words(part, own, WORD_BYTES, hashed=False)
                low = part.tobytes().lower()
                for d in range(j - i):
                    a, b = words.first[d], words.first[d + 1]
                    rows.append(_row(low[own[d] : own[d + 1]], words.starts[a:b] - own[d], words.ends[a:b] - own[d], scanner, phrases))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, SCHEMA)


def _row(text: bytes, starts: np.ndarray, ends: np.ndarray, scanner: Scanner, phrases: list) -> tuple:
    places, base = [], set()
    for pattern, label in phrases:
        for m in pattern.finditer(text):
            places.append(int(np.searchsorted(starts, m.start())))
            base.add(label)
    kept = []
    if scanner.may_hold(text):
        kept = scanner.detect(" ".join(text[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)))
    labels = base | {d.label for d in kept}
    miss = 1.0
    for w in [d.weight for d in kept] + [0.5] * len(base):
        miss *= 1 - w
    return len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - miss, 9), [f"{d.label}:{d.start}:{d.end}" for d in kept]
