"""Hand-written signature rules for licence notices.

A rule is a line `weight | label | pattern`. A pattern is a row of word expressions: each blank-separated piece is a
regular expression for one whole word (of lower-case letters, digits and characters beyond ASCII); a piece that ends in `?`
after a closing bracket or tilde may be missing; `...N` stands for up to N words of any kind. Rules are ordered: an
earlier one has priority over a later one where their places coincide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The four base phrases and their labels (fixed values of the contract).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Names by which a licence goes in notices: label, then the names' patterns, from the most to the least exact.
NAMES = """
gpl-1.0 | gnu general public licen[sc]e (v|version)~ 1 (0)~ ; gpl (v|version)~ 1 (0)~ (only)~ ; gplv1
gpl-2.0 | gnu general public licen[sc]e (v|version)~ 2 (0)~ ; gnu gpl (v|version)~ 2 (0)~ ; gpl (v|version)~ 2 (0)~ ; gplv2
gpl-3.0 | gnu general public licen[sc]e (v|version)~ 3 (0)~ ; gnu gpl (v|version)~ 3 (0)~ ; gpl (v|version)~ 3 (0)~ ; gplv3
lgpl-2.0 | gnu library general public licen[sc]e ...2 2 (0)~ ; lgpl (v|version)~ 2 0
lgpl-2.1 | gnu lesser general public licen[sc]e (v|version)~ 2 1 ; gnu lgpl (v|version)~ 2 1 ; lgpl (v|version)~ 2 1 ; lgplv2 (1)~
lgpl-3.0 | gnu lesser general public licen[sc]e (v|version)~ 3 (0)~ ; gnu lgpl (v|version)~ 3 (0)~ ; lgpl (v|version)~ 3 (0)~ ; lgplv3
agpl-3.0 | gnu affero general public licen[sc]e (v|version)~ 3 (0)~ ; gnu agpl (v|version)~ 3 (0)~ ; agpl (v|version)~ 3 (0)~ ; agplv3
agpl-1.0 | affero general public licen[sc]e (v|version)~ 1 (0)~
gfdl-1.1 | gnu free documentation licen[sc]e (v|version)~ 1 1 ; gfdl (v|version)~ 1 1
gfdl-1.2 | gnu free documentation licen[sc]e (v|version)~ 1 2 ; gfdl (v|version)~ 1 2
gfdl-1.3 | gnu free documentation licen[sc]e (v|version)~ 1 3 ; gfdl (v|version)~ 1 3
apache-1.0 | apache (software)~ licen[sc]e (v|version)~ 1 0
apache-1.1 | apache (software)~ licen[sc]e (v|version)~ 1 1
apache-2.0 | apache (software)~ licen[sc]e (v|version)~ 2 (0)~ ; asl (v|version)~ 2 0 ; apache 2 (0)~ licen[sc]ed? ; apachev2
cc-by-nc-nd-4.0 | cc by nc nd (v|version)~ 4 0 ; creative commons attribution non ~commercial no deriv(s|atives|ative) (works)~ 4 0 ; creative commons attribution noncommercial noderiv(s|atives) (v|version)~ 4 0
cc-by-nc-sa-4.0 | cc by nc sa (v|version)~ 4 0 ; creative commons attribution non commercial share alike (v|version)~ 4 0 ; creative commons attribution noncommercial sharealike (v|version)~ 4 0
cc-by-nc-sa-3.0 | cc by nc sa (v|version)~ 3 0 ; creative commons attribution noncommercial sharealike (v|version)~ 3 0
cc-by-nc-nd-3.0 | cc by nc nd (v|version)~ 3 0 ; creative commons attribution noncommercial noderivs (v|version)~ 3 0
cc-by-nc-4.0 | cc by nc (v|version)~ 4 0 ; creative commons attribution non commercial (v|version)~ 4 0 ; creative commons attribution noncommercial (v|version)~ 4 0
cc-by-nc-3.0 | cc by nc (v|version)~ 3 0 ; creative commons attribution noncommercial (v|version)~ 3 0
cc-by-nc-2.0 | cc by nc (v|version)~ 2 0 ; creative commons attribution noncommercial (v|version)~ 2 0
cc-by-sa-4.0 | cc by sa (v|version)~ 4 0 ; creative commons attribution share alike (v|version)~ 4 0 ; creative commons attribution sharealike (v|version)~ 4 0
cc-by-sa-3.0 | cc by sa (v|version)~ 3 0 ; creative commons attribution share alike (v|version)~ 3 0 ; creative commons attribution sharealike (v|version)~ 3 0
cc-by-sa-2.0 | cc by sa (v|version)~ 2 [05] ; creative commons attribution sharealike (v|version)~ 2 [05]
cc-by-nd-4.0 | cc by nd (v|version)~ 4 0 ; creative commons attribution no derivatives (v|version)~ 4 0 ; creative commons attribution noderivatives (v|version)~ 4 0
cc-by-nd-3.0 | cc by nd (v|version)~ 3 0 ; creative commons attribution noderivs (v|version)~ 3 0
cc-by-4.0 | cc by (v|version)~ 4 0 ; creative commons attribution (v|version)~ 4 0
cc-by-3.0 | cc by (v|version)~ 3 0 ; creative commons attribution (v|version)~ 3 0
cc-by-2.0 | cc by (v|version)~ 2 [05] ; creative commons attribution (v|version)~ 2 [05]
cc-by-nc-nd | cc by nc nd ; creative commons attribution non ~commercial no derivatives
cc-by-nc-sa | cc by nc sa ; creative commons attribution non ~commercial share alike
cc-by-nc | cc by nc ; creative commons attribution non ~commercial ; creative commons attribution noncommercial
cc-by-sa | cc by sa ; creative commons attribution share alike ; creative commons attribution sharealike
cc-by-nd | cc by nd ; creative commons attribution no derivatives ; creative commons attribution noderivatives
cc0-1.0 | cc0 (1)~ (0)~ (universal)~ ; cc zero (1)~ (0)~ ; creative commons zero ; creative commons public domain dedication ; creative commons ...2 cc0
pddl-1.0 | open data commons public domain dedication ; pddl (v|version)~ 1 0
odbl-1.0 | open database licen[sc]e ; open data commons open database ; odbl (v|version)~ 1 0
odc-by-1.0 | open data commons attribution licen[sc]e ; odc by (v|version)~ 1 0
bsd-4-clause | bsd (4|four) clause ; original bsd licen[sc]e ; bsd licen[sc]e ...2 advertising clause
bsd-3-clause | bsd (3|three) clause ; (new|modified|revised) bsd licen[sc]e ; bsd (new|modified)
bsd-2-clause | bsd (2|two) clause ; simplified bsd licen[sc]e ; freebsd licen[sc]e
bsd-0-clause | bsd zero clause ; 0bsd ; zero clause bsd
isc | isc licen[sc]e ; internet systems consortium licen[sc]e
mpl-1.0 | mozilla public licen[sc]e (v|version)~ 1 0 ; mpl (v|version)~ 1 0
mpl-1.1 | mozilla public licen[sc]e (v|version)~ 1 1 ; mpl (v|version)~ 1 1
mpl-2.0 | mozilla public licen[sc]e (v|version)~ 2 0 ; mpl (v|version)~ 2 0 ; mplv2
epl-1.0 | eclipse public licen[sc]e (v|version)~ 1 0 ; epl (v|version)~ 1 0
epl-2.0 | eclipse public licen[sc]e (v|version)~ 2 0 ; epl (v|version)~ 2 0
edl-1.0 | eclipse distribution licen[sc]e (v|version)~ 1 0
cpl-1.0 | common public licen[sc]e (v|version)~ 1 0
cddl-1.0 | common development and distribution licen[sc]e (v|version)~ 1 0 ; cddl (v|version)~ 1 0
cddl-1.1 | common development and distribution licen[sc]e (v|version)~ 1 1 ; cddl (v|version)~ 1 1
eupl-1.1 | european union public licen[sc]e (v|version)~ 1 1 ; eupl (v|version)~ 1 1
eupl-1.2 | european union public licen[sc]e (v|version)~ 1 2 ; eupl (v|version)~ 1 2
cecill-2.0 | cecill (free)~ (software)~ licen[sc]e ...2 2 0 ; cecill (v|version)~ 2 [01]
cecill-b | cecill b ; cecill c
ms-pl | microsoft public licen[sc]e ; ms pl
ms-rl | microsoft reciprocal licen[sc]e ; ms rl
artistic-1.0 | artistic licen[sc]e (v|version)~ 1 0 ; clarified artistic licen[sc]e
artistic-2.0 | artistic licen[sc]e (v|version)~ 2 0
bsl-1.0 | boost software licen[sc]e (v|version)~ (1)~ (0)~
busl-1.1 | business source licen[sc]e (v|version)~ (1)~ (1)~ ; busl 1 1
sspl-1.0 | server side public licen[sc]e ; sspl (v|version)~ 1
elastic-2.0 | elastic licen[sc]e (v|version)~ 2 (0)~
osl-3.0 | open software licen[sc]e (v|version)~ 3 0 ; osl (v|version)~ 3 0
afl-3.0 | academic free licen[sc]e (v|version)~ 3 0 ; afl (v|version)~ 3 0
ofl-1.1 | sil open font licen[sc]e ; open font licen[sc]e (v|version)~ 1 1 ; ofl (v|version)~ 1 1
zlib | zlib libpng licen[sc]e ; zlib licen[sc]e
libpng | libpng licen[sc]e ; png reference library licen[sc]e
openssl | openssl licen[sc]e ; original ssleay licen[sc]e
php-3.01 | php licen[sc]e (v|version)~ 3 01 ; php licen[sc]e
python-2.0 | python software foundation licen[sc]e ; psf licen[sc]e ; python licen[sc]e (v|version)~ 2
ruby | ruby licen[sc]e
unlicense | the unlicense ; unlicense org ; released into the public domain ; free and unencumbered software
wtfpl | do what the fuck you want to public licen[sc]e ; wtfpl
beerware | beer ware licen[sc]e ; beerware
postgresql | postgresql licen[sc]e
ncsa | university of illinois ncsa ...2 licen[sc]e ; ncsa open source licen[sc]e
upl-1.0 | universal permissive licen[sc]e ; upl (v|version)~ 1 0
vim | vim licen[sc]e
w3c | w3c software (notice)~ (and)~ licen[sc]e ; w3c document licen[sc]e
x11 | x11 licen[sc]e ; mit x11 ; x consortium licen[sc]e
curl | curl licen[sc]e
ipl-1.0 | ibm public licen[sc]e
npl-1.1 | netscape public licen[sc]e
qpl-1.0 | q public licen[sc]e
sleepycat | sleepycat licen[sc]e ; berkeley database licen[sc]e
unicode | unicode licen[sc]e ; unicode inc licen[sc]e agreement ; unicode terms of use
zpl-2.1 | zope public licen[sc]e
lppl-1.3 | latex project public licen[sc]e ; lppl (v|version)~ 1 3
ogl-3.0 | open government licen[sc]e (v|version)~ 3 0
ogl | open government licen[sc]e
etalab-2.0 | licence ouverte ...2 2 0 ; etalab open licen[sc]e
dl-de-by-2.0 | datenlizenz deutschland namensnennung ; dl de by 2 0
rail | responsible ai licen[sc]e ; openrail ; open rail m ; bigscience ...2 rail
community-terms | community licen[sc]e agreement ; acceptable use policy ...6 licen[sc]e
eula | end user licen[sc]e agreement ; software licen[sc]e agreement
"""

#: Notices that say a licence without a version, and wordings of the licence texts themselves: weight, label, pattern.
NOTICES = """
0.95 | mit | permission is hereby granted free of charge to any person obtaining a copy
0.9 | mit | the above copyright notice and this permission notice shall be included in all copies
0.95 | isc | permission to use copy modify and or distribute this software for any purpose
0.95 | bsd | redistribution and use in source and binary forms with or without modification are permitted
0.9 | bsd | redistributions of source code must retain the above copyright notice
0.9 | bsd | redistributions in binary form must reproduce the above copyright notice
0.9 | bsd-3-clause | neither the name of ...12 may be used to endorse or promote products
0.9 | gpl | this program is free software you can redistribute it and or modify
0.9 | gpl | is distributed in the hope that it will be useful but without any warranty
0.95 | gpl-3.0 | either version 3 of the licen[sc]e or at your option any later version
0.95 | gpl-2.0 | either version 2 of the licen[sc]e or at your option any later version
0.95 | lgpl-2.1 | either version 2 1 of the licen[sc]e or at your option any later version
0.95 | apache-2.0 | you may not use this file except in compliance with the licen[sc]e
0.9 | apache-2.0 | apache org licenses licen[sc]e 2 0
0.9 | mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[sc]e
0.9 | mpl-2.0 | mozilla org mpl 2 0
0.9 | bsl-1.0 | boost org licen[sc]e 1 0
0.9 | zlib | this software is provided as is without any express or implied warranty in no event
0.9 | unlicense | this is free and unencumbered software released into the public domain
0.9 | cc0-1.0 | to the extent possible under law ...12 waived all copyright
0.9 | cc-by-4.0 | creativecommons org licenses by 4 0
0.9 | cc-by-3.0 | creativecommons org licenses by 3 0
0.9 | cc-by-sa-4.0 | creativecommons org licenses by sa 4 0
0.9 | cc-by-sa-3.0 | creativecommons org licenses by sa 3 0
0.9 | cc-by-nc-4.0 | creativecommons org licenses by nc 4 0
0.9 | cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0
0.9 | cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0
0.9 | cc-by-nd-4.0 | creativecommons org licenses by nd 4 0
0.9 | cc0-1.0 | creativecommons org publicdomain zero 1 0
0.9 | public-domain | creativecommons org publicdomain mark 1 0
0.9 | gpl | gnu org licenses gpl
0.9 | lgpl | gnu org licenses lgpl
0.9 | agpl | gnu org licenses agpl
0.9 | gfdl | gnu org licenses fdl
0.9 | mit | opensource org licenses mit
0.9 | apache-2.0 | opensource org licenses apache 2 0
0.9 | bsd | opensource org licenses bsd
0.85 | lgpl | gnu lesser general public licen[sc]e
0.85 | lgpl | gnu library general public licen[sc]e
0.85 | agpl | gnu affero general public licen[sc]e
0.85 | gfdl | gnu free documentation licen[sc]e
0.85 | gpl | gnu general public licen[sc]e
0.8 | gpl | general public licen[sc]e
0.8 | gpl | (under|by) the gnu gpl
0.8 | gpl | gnu gpl
0.7 | gpl | (licensed|released|distributed) under (the)~ gpl
0.7 | lgpl | (licensed|released|distributed) under (the)~ lgpl
0.7 | agpl | (licensed|released|distributed) under (the)~ agpl
0.8 | apache | (licensed|released|distributed) under (the)~ apache
0.8 | apache | apache (software)~ licen[sc]e
0.8 | mit | (licensed|released|distributed) under (the)~ mit
0.8 | mit | mit (style)~ licen[sc]e
0.8 | mit | expat licen[sc]e
0.8 | bsd | (licensed|released|distributed) under (a|the)~ bsd
0.8 | bsd | bsd (style)~ licen[sc]e
0.8 | mpl | mozilla public licen[sc]e
0.8 | epl | eclipse public licen[sc]e
0.8 | cddl | common development and distribution licen[sc]e
0.8 | eupl | european union public licen[sc]e
0.8 | artistic | (perl)~ artistic licen[sc]e
0.8 | cecill | cecill licen[sc]e
0.8 | cc-by | creative commons attribution
0.75 | cc-by | cc by
0.7 | cc | creative commons licen[sc]e
0.7 | cc | licensed under (a)~ creative commons
0.6 | cc | creative commons
0.7 | public-domain | (dedicated|released|placed|is) (to|into|in) the public domain
0.6 | public-domain | public domain (dedication|mark|work)
0.9 | spdx | spdx licen[sc]e identifier
0.7 | proprietary | all rights reserved
0.7 | proprietary | proprietary and confidential
0.7 | proprietary | unauthorized (copying|use|reproduction) ...6 prohibited
0.7 | proprietary | may not be reproduced ...8 without ...4 permission
0.6 | commercial | commercial licen[sc]e
0.6 | commercial | licensed ...4 commercial use
0.6 | non-commercial | (for)~ non commercial use only
0.6 | non-commercial | noncommercial use only
0.6 | research-only | for research purposes only
0.6 | academic-only | academic (and research)~ use only
0.5 | open-source | open source licen[sc]ed?
0.5 | open-source | free software licen[sc]e
0.5 | permissive | permissive licen[sc]e
0.5 | copyleft | copyleft licen[sc]e
0.4 | copyright | copyright (c)~ (19|20)[0-9][0-9]
0.4 | copyright | copyright holders? ...2 reserved
0.4 | unstated | (licensed|released|distributed) under (the)~ (terms of)~ ...3 licen[sc]e
0.3 | unstated | (this|the) (work|software|document|program|content) is licensed
0.3 | unstated | licen[sc]e agreement
0.3 | unstated | see (the)~ licen[sc]e (file)~ for details
"""


@dataclass(frozen=True)
class Rule:
    priority: int
    weight: float
    label: str
    keywords: tuple[str, ...]
    regex: str


#: Words that tell little (mit is a common German word), so that a rule is not gated by them while it has another.
_WEAK = frozenset("a an and any as at be by for from in into is it mit of on or the this to under use with you that may not no 0 1 2 3 4 v version all rights see".split())
_ANY_OF = re.compile(r"\(?([a-z0-9]+(?:\|[a-z0-9]+)*)\)?")
_LICENCE = {"licen[sc]e": ("license", "licence"), "licen[sc]ed?": ("license", "licence", "licensed", "licenced")}


def keywords(pattern: str) -> tuple[str, ...]:
    """Words of which every match of the pattern holds at least one: what gates its rule."""
    found = []
    for piece in pattern.split():
        if piece in _LICENCE:
            found.append(_LICENCE[piece])
        elif (m := _ANY_OF.fullmatch(piece.lstrip("~"))):
            found.append(tuple(m[1].split("|")))
    return max(found, key=lambda words: (not _WEAK & set(words), min(map(len, words))))


def regex(pattern: str) -> str:
    """A pattern over text in which each word has a blank of its own on either side."""
    out = []
    for piece in pattern.split():
        if gap := re.fullmatch(r"\.\.\.(\d+)", piece):
            out.append("(?: [^ ]+ ){0,%d}?" % int(gap[1]))
        elif piece.endswith("~"):
            out.append(f"(?: (?:{piece[:-1]}) )?")
        else:
            out.append(f" (?:{piece.lstrip('~')}) ")
    return "".join(out)


def _split(pattern: str) -> str:
    """Brackets with several words, such as (terms of)~, written as pieces of their own."""
    return re.sub(r"\(([a-z ]+ [a-z ]+)\)~", lambda m: " ".join(f"({w})~" for w in m[1].split()), pattern)


def rules() -> list[Rule]:
    """All rules in order of priority: full names with versions, licence texts and notices, then prefixed variants."""
    found: list[tuple[float, str, str]] = []
    for line in NAMES.strip().splitlines():
        label, patterns = (x.strip() for x in line.split("|", 1))
        found += [(0.95, label, p.strip()) for p in patterns.split(" ; ")]
    for line in NOTICES.strip().splitlines():
        weight, label, pattern = (x.strip() for x in line.split("|", 2))
        found.append((float(weight), label, pattern))
    return [Rule(i, w, label, keywords(_split(p)), regex(_split(p))) for i, (w, label, p) in enumerate(found)]
