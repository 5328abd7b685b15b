"""Signatures of licences: regular expressions over lower-cased words with one space between them.

A rule is (label, gate words, expression). It is tried only on texts that hold every one of its
gate words, and each of its matches holds them. Matches begin and end with whole words.
"""

from __future__ import annotations

from dataclasses import dataclass

ONE = r"(?: version| ver| v)? v?1(?: 0)?"
TWO = r"(?: version| ver| v)? v?2(?: 0)?"
THREE = r"(?: version| ver| v)? v?3(?: 0)?"
LATER = r"(?: or(?: at your option)?(?: any)? later(?: version)?)?"
LIC = r"(?: public)? licen[cs]e"
CC = r"(?:creative commons|cc)"

#: How licences are named.
NAMES = [
    ("0bsd", "0bsd", r"0bsd(?: licen[cs]e)?"),
    ("0bsd", "zero clause bsd", r"zero clause bsd licen[cs]e"),
    ("afl-3.0", "academic free", rf"academic free licen[cs]e{THREE}"),
    ("afl-2.1", "academic free", r"academic free licen[cs]e(?: version| v)? v?2 1"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[cs]e{THREE}{LATER}"),
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl(?:{THREE}{LATER})?"),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3"),
    ("agpl-1.0", "affero", rf"affero general public licen[cs]e{ONE}{LATER}"),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: licen[cs]e)?{TWO}(?: licen[cs]e)?"),
    ("apache-2.0", "asl", rf"asl{TWO}"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version| v)? v?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e(?: version| v)? v?1 0"),
    ("apache", "apache license", r"apache(?: software)? license"),
    ("apsl-2.0", "apple source", rf"apple public source licen[cs]e{TWO}"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{TWO}"),
    ("artistic-1.0", "artistic", rf"artistic licen[cs]e{ONE}"),
    ("artistic", "perl itself", r"same terms as perl itself"),
    ("bsd-2-clause", "bsd 2 clause", r"bsd 2 clause(?: simplified)?(?: licen[cs]e)?"),
    ("bsd-2-clause", "2 clause bsd", r"2 clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "simplified bsd", r"simplified bsd licen[cs]e"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd 3 clause", r"bsd 3 clause(?: new| revised)?(?: licen[cs]e)?"),
    ("bsd-3-clause", "3 clause bsd", r"3 clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-3-clause-clear", "clear bsd", r"clear bsd licen[cs]e"),
    ("bsd-4-clause", "bsd 4 clause", r"bsd 4 clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd original", r"original bsd licen[cs]e"),
    ("bsd", "bsd", r"bsd(?: style| type)? licen[cs]e"),
    ("bsl-1.0", "boost", rf"boost software licen[cs]e(?:{ONE})?"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?:(?: version| v)? v?1 1)?"),
    ("cc-by", "attribution", rf"{CC} attribution(?: [1-4] [0-9])?(?: international| unported| generic)?(?:{LIC})?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [0-9])"),
    ("cc-by-sa", "sharealike", rf"{CC}(?: by| attribution) sharealike(?: [1-4] [0-9])?(?: international| unported)?(?:{LIC})?"),
    ("cc-by-sa", "share alike", rf"{CC}(?: by| attribution) share alike(?: [1-4] [0-9])?(?: international| unported)?(?:{LIC})?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [0-9])?"),
    ("cc-by-nc", "noncommercial", rf"{CC} attribution noncommercial(?: [1-4] [0-9])?(?: international| unported)?(?:{LIC})?"),
    ("cc-by-nc", "non commercial", rf"{CC} attribution non commercial(?: [1-4] [0-9])?(?: international| unported)?(?:{LIC})?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "noncommercial sharealike", rf"{CC} attribution noncommercial sharealike(?: [1-4] [0-9])?(?: international| unported)?(?:{LIC})?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [0-9])?"),
    ("cc-by-nc-nd", "noncommercial noderivatives", rf"{CC} attribution noncommercial noderivatives(?: [1-4] [0-9])?(?: international| unported)?(?:{LIC})?"),
    ("cc-by-nc-nd", "noncommercial noderivs", rf"{CC} attribution noncommercial noderivs(?: [1-4] [0-9])?(?: unported)?(?:{LIC})?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [0-9])?"),
    ("cc-by-nd", "noderivatives", rf"{CC} attribution noderivatives(?: [1-4] [0-9])?(?: international| unported)?(?:{LIC})?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [0-9])?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", "zero", rf"{CC} zero(?:{ONE})?(?: universal)?(?:{LIC})?"),
    ("cddl-1.0", "common development distribution", rf"common development and distribution licen[cs]e(?:{ONE})?"),
    ("cddl-1.0", "cddl", rf"cddl(?:{ONE})?"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?(?:(?: version| v)? v?2 1)?"),
    ("cpl-1.0", "common", rf"common public licen[cs]e(?:{ONE})?"),
    ("ecl-2.0", "educational community", rf"educational community licen[cs]e(?:{TWO})?"),
    ("efl-2.0", "eiffel", rf"eiffel forum licen[cs]e(?:{TWO})?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{ONE}"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{TWO}"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("etalab-2.0", "etalab", r"(?:licence ouverte )?etalab(?: 2 0)?"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?:(?: version| v)? v?1 [12])?"),
    ("eupl-1.2", "eupl", r"eupl(?: v?1 [12])?"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation licen[cs]e(?:(?: version| v)? v?1 [1-3])?"),
    ("gfdl-1.3", "gfdl", r"gfdl(?: v?1 [1-3])?"),
    ("gpl-1.0", "general", rf"(?:gnu )?general public licen[cs]e{ONE}{LATER}"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public licen[cs]e{TWO}{LATER}"),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{TWO}{LATER}"),
    ("gpl-2.0", "gplv2", rf"(?:gnu )?gplv2{LATER}"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public licen[cs]e{THREE}{LATER}"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{THREE}{LATER}"),
    ("gpl-3.0", "gplv3", rf"(?:gnu )?gplv3{LATER}"),
    ("gpl", "gnu general", r"gnu general public licen[cs]e"),
    ("gpl", "gnu gpl", r"gnu gpl"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("icu", "icu", r"icu licen[cs]e"),
    ("ijg", "jpeg", r"independent jpeg group(?: s)? licen[cs]e"),
    ("ipl-1.0", "ibm", rf"ibm public licen[cs]e(?:{ONE})?"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("lgpl-2.0", "library", rf"(?:gnu )?library general public licen[cs]e(?:{TWO})?{LATER}"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[cs]e(?: version| v)? v?2 1{LATER}"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl(?: version| v)? v?2 1{LATER}"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{THREE}{LATER}"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl{THREE}{LATER}"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("llama", "llama community", r"llama [1-4](?: [0-9])? community licen[cs]e(?: agreement)?"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e(?:(?: version| v)? v?1 3c?)?"),
    ("mit", "mit license", r"mit(?: x11)? license"),
    ("mit", "mit licence", r"mit(?: x11)? licence"),
    ("mit", "expat", r"expat(?: mit)? licen[cs]e"),
    ("mit-0", "mit attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", "mit 0", r"mit 0 licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version| v)? v?1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{TWO}"),
    ("mpl-2.0", "mpl", rf"mpl{TWO}"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("mulanpsl-2.0", "mulan", r"mulan(?: permissive software licen[cs]e| psl)(?: v2| v?1)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("odbl-1.0", "open database", rf"open(?: data commons)?(?: open)? database licen[cs]e(?:{ONE})?"),
    ("odbl-1.0", "odbl", rf"odbl(?:{ONE})?"),
    ("odc-by-1.0", "open data commons attribution", rf"open data commons attribution licen[cs]e(?:{ONE})?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?:(?: version| v)? v?1 1)?"),
    ("ogl-3.0", "open government", r"open government licen[cs]e(?:(?: version| v)? v?[1-3](?: 0)?)?"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("osl-3.0", "open software", rf"open software licen[cs]e(?:{THREE})?"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e"),
    ("php-3.01", "php", r"php licen[cs]e(?:(?: version| v)? v?3 01)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("proprietary", "proprietary", r"proprietary(?: and confidential)?(?: software)? licen[cs]e"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("psf-2.0", "python foundation", r"python software foundation licen[cs]e(?:(?: version| v)? v?2)?"),
    ("qpl-1.0", "q", rf"q public licen[cs]e(?:{ONE})?"),
    ("rail", "responsible ai", r"(?:bigscience |creativeml )?(?:open )?responsible ai licen[cs]e"),
    ("rail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?"),
    ("ruby", "ruby", r"ruby(?: s)? licen[cs]e"),
    ("sspl-1.0", "server side", rf"server side public licen[cs]e(?:{ONE})?"),
    ("sspl-1.0", "sspl", rf"sspl(?:{ONE})?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("upl-1.0", "universal permissive", rf"universal permissive licen[cs]e(?:{ONE})?"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("w3c", "w3c", r"w3c software(?: notice and)?(?: document)? licen[cs]e"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v?2)?"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?:(?: version| v)? v?2 [01])?"),
]

#: Where licences are kept; words of an address.
URLS = [
    ("agpl-3.0", "gnu agpl", r"gnu org licenses agpl(?: 3 0)?"),
    ("apache-2.0", "apache licenses", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache licenses", r"apache org licenses license 1 1"),
    ("artistic-2.0", "perlfoundation", r"perlfoundation org artistic license 2 0"),
    ("bsl-1.0", "boost", r"boost org license 1 0"),
    ("cc-by", "creativecommons by", r"creativecommons org licenses by [1-4] [0-9]"),
    ("cc-by-sa", "creativecommons by sa", r"creativecommons org licenses by sa [1-4] [0-9]"),
    ("cc-by-nc", "creativecommons by nc", r"creativecommons org licenses by nc [1-4] [0-9]"),
    ("cc-by-nd", "creativecommons by nd", r"creativecommons org licenses by nd [1-4] [0-9]"),
    ("cc-by-nc-sa", "creativecommons by nc sa", r"creativecommons org licenses by nc sa [1-4] [0-9]"),
    ("cc-by-nc-nd", "creativecommons by nc nd", r"creativecommons org licenses by nc nd [1-4] [0-9]"),
    ("cc0-1.0", "creativecommons zero", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons mark", r"creativecommons org publicdomain mark 1 0"),
    ("cddl-1.0", "cddl", r"opensource org licenses cddl(?: 1 0)?"),
    ("epl-1.0", "eclipse epl", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse epl", r"eclipse org legal epl 2 0"),
    ("eupl-1.2", "eupl", r"joinup ec europa eu(?: [a-z0-9]+)* eupl"),
    ("gfdl-1.3", "gnu fdl", r"gnu org (?:copyleft|licenses) fdl"),
    ("gpl", "gnu gpl", r"gnu org (?:copyleft|licenses) gpl"),
    ("gpl-2.0", "gnu gpl", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu gpl", r"gnu org licenses gpl 3 0"),
    ("isc", "opensource isc", r"opensource org licenses isc"),
    ("lgpl", "gnu lgpl", r"gnu org (?:copyleft|licenses) lgpl"),
    ("lgpl", "gnu lesser", r"gnu org (?:copyleft|licenses) lesser"),
    ("lgpl-2.1", "gnu lgpl", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu lgpl", r"gnu org licenses lgpl 3 0"),
    ("mit", "opensource mit", r"opensource org licenses mit"),
    ("mit", "choosealicense mit", r"choosealicense com licenses mit"),
    ("mpl-2.0", "mozilla mpl", r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla mpl", r"mozilla org mpl mpl 1 1"),
    ("odbl-1.0", "opendatacommons odbl", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "opendatacommons by", r"opendatacommons org licenses by"),
    ("ofl-1.1", "scripts ofl", r"scripts sil org ofl"),
    ("ogl-3.0", "nationalarchives", r"nationalarchives gov uk doc open government licence"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
    ("zlib", "zlib", r"zlib net zlib license"),
]

#: Sentences that licence texts and notices consist of.
TEXTS = [
    ("mit", "obtaining copy", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "substantial", r"this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "hereby fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("hpnd", "fee hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,12}?nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?(?:www )?apache org"),
    ("apache-2.0", "specific", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "contributor perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", "basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "redistribute free foundation", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "hope useful", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2.0", "june 1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", "june 2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "freedom share", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl", "redistribute lesser", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.0", "terms library", r"under the terms of the gnu library general public license"),
    ("lgpl-3.0", "supplemented", r"incorporates the terms and conditions of version 3 of the gnu general public license supplemented by"),
    ("agpl-3.0", "redistribute affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl-1.3", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "subject mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "contents development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin", r"the origin of this software must not be misrepresented"),
    ("zlib", "damages arising", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "obtaining organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", r"do what the fuck you want to(?: public license)?"),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "dedicated", r"dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc-by", "adapt credit", r"you are free to share and adapt the material(?: for any purpose)? (?:[^ ]+ ){0,12}?appropriate credit"),
    ("cc-by-sa", "remix transform", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix distribute modified", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl-1.1", "reserved font", r"with reserved font names?"),
    ("ofl-1.1", "fonts", r"the fonts and derivatives however cannot be released under any other type of license"),
    ("artistic-2.0", "gratis", r"you may distribute your modified version as source either gratis or for a distributor fee"),
    ("psf-2.0", "psf", r"psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ncsa", "illinois", r"neither the names of (?:[^ ]+ ){1,10}?university of illinois nor the names of its contributors"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("busl-1.1", "production", r"the licensor may make an additional use grant above permitting limited production use"),
    ("sspl-1.0", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "grant sell", r"the license does not grant to you the right to sell the software"),
    ("rail", "restrictions", r"use based restrictions as referenced in paragraph 5"),
    ("llama", "llama", r"meta llama [1-4] is licensed under the meta llama [1-4] community license"),
    ("proprietary", "unauthorized", r"unauthorized copying of this (?:file|document|work|software)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("proprietary", "permission", r"(?:may not|must not|no part of (?:[^ ]+ ){1,6}?may) be (?:reproduced|copied|distributed|published)(?: [^ ]+){0,16}? without (?:the )?(?:prior )?(?:written |express )*permission"),
    ("reserved", "copyright", r"copyright(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: [^ ]+){0,8}? all rights reserved"),
    ("reserved", "rechte", r"alle rechte vorbehalten"),
    ("reserved", "droits", r"tous droits réservés"),
    ("reserved", "derechos", r"todos los derechos reservados"),
    ("reserved", "diritti", r"tutti i diritti riservati"),
    ("reserved", "direitos", r"todos os direitos reservados"),
    ("public-domain", "copyright", r"no known copyright(?: restrictions)?"),
    ("public-domain", "gemeinfrei", r"gemeinfrei"),
    ("public-domain", "domaine", r"(?:dans le|du) domaine public"),
    ("fair-use", "fair", r"fair use notice"),
    ("etalab-2.0", "ouverte", r"licence ouverte(?: open licence)?"),
]

#: (label, words): the phrases whose places every scan reports.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

GRANT = (
    r"(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|shared) (?:for use )?(?:under|with|by)"
    r"(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: an?)? "
)
TAG = r"spdx licen[cs]e identifier "
FIELD = r"(?:licen[cs]e|licensing|rights|copyright|terms) (?:is |are |type |name |id )?(?:the )?"

#: Kinds of rules, best first, with the trust in what they find.
KINDS = {"text": 1.0, "tag": 1.0, "grant": 0.95, "url": 0.9, "field": 0.8, "name": 0.7, "phrase": 0.4}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    gate: frozenset[str]
    expression: str


def _tag(label: str) -> str:
    """An identifier as words, with the endings that identifiers have."""
    return TAG + label.replace("-", " ").replace(".", " ") + r"(?: [0-9](?: [0-9])?)?(?: only| or later)?"


def rules() -> list[Rule]:
    """All rules, best kind first; in a kind, in the order of the lists."""
    found = [Rule(label, "text", frozenset(gate.split()), e) for label, gate, e in TEXTS]
    found += [Rule(label, "tag", frozenset(["spdx", "identifier", label.split("-")[0].split(".")[0]]), _tag(label)) for label in dict.fromkeys(n[0] for n in NAMES)]
    found += [Rule(label, "grant", frozenset(gate.split()), f"{GRANT}(?:{e})") for label, gate, e in NAMES]
    found += [Rule(label, "url", frozenset(gate.split()), e) for label, gate, e in URLS]
    found += [Rule(label, "field", frozenset(gate.split()), f"{FIELD}(?:{e})") for label, gate, e in NAMES]
    found += [Rule(label, "name", frozenset(gate.split()), e) for label, gate, e in NAMES]
    return found
