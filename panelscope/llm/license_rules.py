"""Signature rules for licenses, written for text of lower-case words with one space between.

A rule is (label, priority, confidence, keyword, pattern).  The keyword is a
literal that the pattern can't match without; it gates the pattern.  Names,
identifiers, addresses and notice sentences of one license are rules of their
own, ordered: notice over identifier over address over name.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern[str]


#: label | keyword | name pattern.  Fixed values: names by which licenses are known.
NAMES = r"""
mit | mit | mit licen[sc]e
mit | mit | mit expat licen[sc]e
mit | expat | expat licen[sc]e
mit | mit | mit style licen[sc]e
mit | massachusetts | massachusetts institute of technology licen[sc]e
mit-0 | mit no attribution | mit no attribution(?: licen[sc]e)?
x11 | x11 | x11 licen[sc]e
apache-1 | apache | apache software licen[sc]e (?:version |v )?1 0
apache-1.1 | apache | apache software licen[sc]e (?:version |v )?1 1
apache-2 | apache | apache licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | apache | apache software licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | apache | apache 2(?: 0)? licen[sc]e
apache-2 | asl 2 | asl 2 0
apache | apache | apache (?:software )?licen[sc]e
bsd-4 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd) licen[sc]e
bsd-3 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
bsd-2 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd) licen[sc]e
bsd-2 | freebsd | freebsd licen[sc]e
bsd-0 | bsd | (?:bsd 0 clause|0 clause bsd|zero clause bsd) licen[sc]e
bsd-0 | free public | free public licen[sc]e
bsd | bsd | bsd (?:style )?licen[sc]e
isc | isc | isc licen[sc]e
isc | internet systems consortium | internet systems consortium licen[sc]e
gpl-1 | public licen | gnu general public licen[sc]e (?:version |v )1(?: 0)?
gpl-2 | public licen | gnu general public licen[sc]e (?:version |v )2(?: 0)?
gpl-2+ | public licen | gnu general public licen[sc]e (?:version |v )2(?: 0)? or (?:any )?later(?: version)?
gpl-3 | public licen | gnu general public licen[sc]e (?:version |v )3(?: 0)?
gpl-3+ | public licen | gnu general public licen[sc]e (?:version |v )3(?: 0)? or (?:any )?later(?: version)?
gpl | public licen | gnu general public licen[sc]e
gpl-2 | gpl | (?:gnu )?gpl ?v ?2(?: 0)?
gpl-3 | gpl | (?:gnu )?gpl ?v ?3(?: 0)?
gpl | gpl | gnu gpl
lgpl-2 | public licen | gnu library general public licen[sc]e (?:version |v )2(?: 0)?
lgpl-2.1 | public licen | gnu lesser general public licen[sc]e (?:version |v )2 1
lgpl-3 | public licen | gnu lesser general public licen[sc]e (?:version |v )3(?: 0)?
lgpl | public licen | gnu (?:lesser|library) general public licen[sc]e
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?v ?2 1
lgpl-3 | lgpl | (?:gnu )?lgpl ?v ?3(?: 0)?
agpl-3 | public licen | gnu affero general public licen[sc]e(?: (?:version |v )3(?: 0)?)?
agpl-1 | public licen | affero general public licen[sc]e (?:version |v )1(?: 0)?
agpl-3 | agpl | (?:gnu )?agpl ?v ?3(?: 0)?
gfdl-1.1 | free documentation | gnu free documentation licen[sc]e (?:version |v )1 1
gfdl-1.2 | free documentation | gnu free documentation licen[sc]e (?:version |v )1 2
gfdl-1.3 | free documentation | gnu free documentation licen[sc]e (?:version |v )1 3
gfdl | free documentation | gnu free documentation licen[sc]e
mpl-1.0 | mozilla | mozilla public licen[sc]e (?:version |v )?1 0
mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v )?1 1
mpl-2 | mozilla | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl | mozilla | mozilla public licen[sc]e
epl-1 | eclipse | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl-2 | eclipse | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl | eclipse | eclipse public licen[sc]e
edl-1 | eclipse | eclipse distribution licen[sc]e(?: (?:version |v )?1(?: 0)?)?
cpl-1 | common public | common public licen[sc]e(?: (?:version |v )?1(?: 0)?)?
cddl-1 | common development | common development and distribution licen[sc]e (?:version |v )?1(?: 0)?
cddl-1.1 | common development | common development and distribution licen[sc]e (?:version |v )?1 1
cddl | common development | common development and distribution licen[sc]e
eupl-1.1 | european union | european union public licen[sc]e (?:version |v )?1 1
eupl-1.2 | european union | european union public licen[sc]e (?:version |v )?1 2
eupl | european union | european union public licen[sc]e
artistic-1 | artistic | artistic licen[sc]e (?:version |v )?1(?: 0)?
artistic-2 | artistic | artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic | artistic | (?:the )?(?:perl )?artistic licen[sc]e
zlib | zlib | (?:zlib|zlib libpng) licen[sc]e
zlib | libpng | libpng licen[sc]e
bsl-1 | boost | boost software licen[sc]e(?: (?:version |v )?1(?: 0)?)?
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
wtfpl | what the fuck | do what the fuck you want to public licen[sc]e
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
python-2 | python | python software foundation licen[sc]e(?: (?:version |v )?2)?
php-3 | php | php licen[sc]e(?: (?:version |v )?3(?: 0)?)?
ruby | ruby | ruby licen[sc]e
openssl | openssl | openssl licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
w3c | w3c | w3c (?:software )?(?:notice and )?licen[sc]e
ofl-1.1 | open font | (?:sil )?open font licen[sc]e(?: (?:version |v )?1 1)?
odbl-1 | open database | open database licen[sc]e(?: (?:version |v )?1(?: 0)?)?
odc-by-1 | open data commons | open data commons attribution licen[sc]e(?: (?:version |v )?1(?: 0)?)?
pddl-1 | public domain dedication | (?:open data commons )?public domain dedication and licen[sc]e
osl-3 | open software | open software licen[sc]e(?: (?:version |v )?3(?: 0)?)?
afl-3 | academic free | academic free licen[sc]e(?: (?:version |v )?3(?: 0)?)?
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
sspl-1 | server side public | server side public licen[sc]e(?: (?:version |v )?1)?
busl-1.1 | business source | business source licen[sc]e(?: (?:version |v )?1 1)?
elastic-2 | elastic | elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?
commons-clause | commons clause | commons clause(?: licen[sc]e)?
polyform-nc | polyform | polyform noncommercial licen[sc]e
openrail | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?
openrail | open rail | (?:creativeml |bigscience )?open rail(?: m)?(?: licen[sc]e)?
llama-community | llama | llama \d(?: \d)? community licen[sc]e
cecill | cecill | cecill(?: (?:a|b|c))?(?: free software)? licen[sc]e
mulan-2 | mulan | mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?(?: v ?2| version 2)?
nasa-1.3 | nasa | nasa open source agreement(?: (?:version )?1 3)?
ipl-1 | ibm public | ibm public licen[sc]e(?: (?:version |v )?1(?: 0)?)?
apsl-2 | apple public | apple public source licen[sc]e(?: (?:version |v )?2(?: 0)?)?
qpl-1 | q public | q public licen[sc]e(?: (?:version |v )?1(?: 0)?)?
lppl-1.3c | latex project | latex project public licen[sc]e(?: (?:version |v )?1 3c)?
vim | vim | vim licen[sc]e
json | json | json licen[sc]e
beerware | beer | beer ?ware licen[sc]e
"""

#: Creative Commons: parts of the short form, label ending, words of the long form.
CREATIVE = {
    "by": ("by", "attribution"),
    "by sa": ("by-sa", "attribution share ?alike"),
    "by nc": ("by-nc", "attribution non ?commercial"),
    "by nd": ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    "by nc sa": ("by-nc-sa", "attribution non ?commercial share ?alike"),
    "by nc nd": ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
}
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: label | identifier words, as in "SPDX-License-Identifier: ..."
IDENTIFIERS = r"""
mit | mit
mit-0 | mit 0
apache-1.1 | apache 1 1
apache-2 | apache 2 0
bsd-2 | bsd 2 clause
bsd-3 | bsd 3 clause
bsd-4 | bsd 4 clause
bsd-0 | 0bsd
isc | isc
gpl-2 | gpl 2 0(?: only)?
gpl-2+ | gpl 2 0 or later
gpl-3 | gpl 3 0(?: only)?
gpl-3+ | gpl 3 0 or later
lgpl-2 | lgpl 2 0(?: only| or later)?
lgpl-2.1 | lgpl 2 1(?: only| or later)?
lgpl-3 | lgpl 3 0(?: only| or later)?
agpl-3 | agpl 3 0(?: only| or later)?
gfdl-1.3 | gfdl 1 3(?: only| or later)?
mpl-1.1 | mpl 1 1
mpl-2 | mpl 2 0
epl-1 | epl 1 0
epl-2 | epl 2 0
cddl-1 | cddl 1 0
eupl-1.2 | eupl 1 2
artistic-2 | artistic 2 0
zlib | zlib
bsl-1 | bsl 1 0
unlicense | unlicense
wtfpl | wtfpl
cc0-1 | cc0 1 0
ofl-1.1 | ofl 1 1
odbl-1 | odbl 1 0
ms-pl | ms pl
ms-rl | ms rl
ncsa | ncsa
python-2 | psf 2 0|python 2 0
postgresql | postgresql
sspl-1 | sspl 1 0
busl-1.1 | busl 1 1
"""

#: label | address words
ADDRESSES = r"""
mit | opensource org licenses? mit
apache-2 | apache org licenses license 2 0
apache-2 | opensource org licenses? apache 2 0
bsd-2 | opensource org licenses? bsd 2 clause
bsd-3 | opensource org licenses? bsd 3 clause
isc | opensource org licenses? isc
gpl-2 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gnu org licenses gpl 3 0
gpl | gnu org licenses gpl
lgpl-2.1 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | gnu org licenses lgpl 3 0
agpl-3 | gnu org licenses agpl 3 0
gfdl-1.3 | gnu org licenses fdl 1 3
mpl-2 | mozilla org (?:en us )?mpl 2 0
epl-1 | eclipse org legal epl v10
epl-2 | eclipse org legal epl (?:2 0|v20)
bsl-1 | boost org license 1 0
unlicense | unlicense org
wtfpl | wtfpl net
cc0-1 | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org publicdomain mark 1 0
ofl-1.1 | scripts sil org ofl
odbl-1 | opendatacommons org licenses odbl
odc-by-1 | opendatacommons org licenses by
pddl-1 | opendatacommons org licenses pddl
"""

#: label | keyword | sentences of the license texts and of notices
NOTICES = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | endorse or promote | neither the names? of(?: (?!neither the names? of )\S+)+? may be used to endorse or promote products derived from this software
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
gpl-2+ | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3+ | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl | free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl-3 | affero | under the terms of the gnu affero general public license as published by
apache-2 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1 | eclipse | made available under the terms of the eclipse public license v1 0
epl-2 | eclipse | made available under the terms of the eclipse public license (?:v )?2 0
unlicense | public domain | this is free and unencumbered software released into the public domain
bsl-1 | boost | distributed under the boost software license version 1 0
wtfpl | you just do | you just do what the fuck you want to
public-domain | public domain | (?:is|are|been|was) (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | public domain | this work is in the public domain
cc0-1 | cc0 | cc0 (?:1 0 )?(?:universal )?(?:public domain dedication)?
cc0-1 | creative commons | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
proprietary | rights reserved | all rights reserved
proprietary | confidential | proprietary and confidential
proprietary | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:.{0,60}? )?(?:is )?(?:strictly )?prohibited
proprietary | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: (?!unauthori[sz]ed (?:copying|use|reproduction|distribution) )\S+)*? (?:is|are) (?:strictly |expressly )?prohibited
non-commercial | commercial | for (?:personal and )?non commercial use only
non-commercial | noncommercial | for (?:personal and )?noncommercial use only
non-commercial | commercial | not for commercial use
no-derivatives | derivative | no derivative works (?:are )?(?:permitted|allowed)
no-training | machine learning | may not be used (?:for|to train) machine learning
no-training | artificial intelligence | may not be used (?:for|to train) artificial intelligence
no-training | training | (?:ai|model|machine learning) training is (?:not permitted|prohibited)
research-only | research | for research (?:purposes|use) only
"""

#: Words before a name that make a mention a grant.
GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered)(?: \w+){0,3}? under (?:the )?(?:terms of (?:the )?)?"


def _lines(text: str) -> list[list[str]]:
    # the separator has spaces around it; alternatives inside a pattern have none
    return [line.split(" | ") for line in text.strip().splitlines()]


def _rule(label: str, priority: int, confidence: float, keyword: str, pattern: str) -> Rule:
    return Rule(label, priority, confidence, keyword, re.compile(rf"(?<= )(?:{pattern})(?= )"))


def build() -> list[Rule]:
    rules: list[Rule] = []
    for label, keyword, name in _lines(NAMES):
        rules.append(_rule(label, 40, 0.7, keyword, name))
        rules.append(_rule(label, 60, 0.95, keyword, GRANT + name))
    for parts, (ending, long) in CREATIVE.items():
        label = f"cc-{ending}"
        rules.append(_rule(label, 42 + len(parts), 0.8, f"cc {parts}", f"cc {parts}"))
        rules.append(_rule(label, 42 + len(parts), 0.8, "creative commons", f"creative commons {long}(?: international| unported| generic)?(?: licen[sc]e)?"))
        rules.append(_rule(label, 42 + len(parts), 0.8, "creative commons", f"creative commons cc {parts}"))
        rules.append(_rule(label, 72 + len(parts), 0.95, "creativecommons", f"creativecommons org licenses {parts}"))
        for version in VERSIONS:
            exact = f"{label}-{version.replace(' ', '.')}"
            rules.append(_rule(exact, 52 + len(parts), 0.9, f"cc {parts}", f"cc {parts} {version}"))
            rules.append(_rule(exact, 52 + len(parts), 0.9, "creative commons", f"creative commons {long} {version}(?: international| unported| generic)?(?: licen[sc]e)?"))
            rules.append(_rule(exact, 82 + len(parts), 0.98, "creativecommons", f"creativecommons org licenses {parts} {version}"))
    for label, words in _lines(IDENTIFIERS):
        rules.append(_rule(label, 90, 0.99, "spdx license identifier", f"spdx license identifier (?:{words})"))
    for label, words in _lines(ADDRESSES):
        rules.append(_rule(label, 80, 0.95, words.split(" ")[0], words))
    for label, keyword, words in _lines(NOTICES):
        rules.append(_rule(label, 95, 0.98, keyword, words))
    return rules
