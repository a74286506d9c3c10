"""License scans by ordered signature rules.

Each rule is a regular expression with a priority, a label and its own keywords: the
two longest words that every match must hold.  One pass of a keyword automaton over
the lower-cased text selects the rules that can match at all; only these run.  Rules
are clauses and notices of licenses, written by hand (SIGNATURES, CLAUSES), and, for each
family of licenses, its identifiers, addresses, grants and titles (FAMILIES, FORMS).
A space of a rule stands for any white space and comment marks, so wrapped lines match.

Overlapping detections are resolved in order of priority, then length, then place: one
that lies within an accepted one is suppressed.  Accepted intervals that no other
contains are kept in order of their begins, so their ends ascend too and one look-up
answers.  Base phrases (fixed words in succession) are found besides and are never
suppressed.

Defined results: a null or empty text has no words, no labels and score 0; ties
of priority, length and place go to the smaller label; equal rows are judged
each on its own; null ids are passed through; a long text is scanned as a whole; a
column with the name of a result is replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import small_batches
from .decontaminate import BREAKS
from .license_clauses import CLAUSES
from .textcore import joined_bytes, slices, word_bounds

#: Fixed phrases, words in succession, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: label, SPDX identifiers, names as patterns, addresses.
FAMILIES = (
    ("mit", ("mit",), ("mit",), ("opensource.org/licenses/mit",)),
    ("mit-0", ("mit-0",), ("mit no attribution",), ()),
    ("x11", ("x11",), ("x11", "mit/x11"), ()),
    ("apache", ("apache",), ("apache(?: software)?",), ("apache.org/licenses",)),
    ("apache-1.1", ("apache-1.1",), (r"apache(?: software)? license,? (?:version )?1\.1",), ("apache.org/licenses/license-1.1",)),
    ("apache-2.0", ("apache-2.0",), (r"apache(?: software)? license,? (?:version )?2\.0", r"apache 2(?:\.0)?"), ("apache.org/licenses/license-2.0",)),
    ("gpl", ("gpl",), ("gnu general public", "gpl"), ("gnu.org/licenses/gpl", "gnu.org/copyleft/gpl")),
    ("gpl-2.0", ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"), (r"(?:gnu )?general public license,? (?:version )?2(?:\.0)?", r"gpl ?v?2(?:\.0)?"), ("gnu.org/licenses/old-licenses/gpl-2.0",)),
    ("gpl-3.0", ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"), (r"(?:gnu )?general public license,? (?:version )?3(?:\.0)?", r"gpl ?v?3(?:\.0)?"), ("gnu.org/licenses/gpl-3.0",)),
    ("lgpl", ("lgpl",), ("gnu (?:lesser|library) general public", "lgpl"), ("gnu.org/licenses/lgpl",)),
    ("lgpl-2.1", ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"), (r"lesser general public license,? (?:version )?2\.1", r"lgpl ?v?2\.1"), ("gnu.org/licenses/old-licenses/lgpl-2.1",)),
    ("lgpl-3.0", ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"), (r"lesser general public license,? (?:version )?3(?:\.0)?", r"lgpl ?v?3(?:\.0)?"), ("gnu.org/licenses/lgpl-3.0",)),
    ("agpl-3.0", ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), ("gnu affero general public", "affero general public", r"agpl ?v?3(?:\.0)?", "agpl"), ("gnu.org/licenses/agpl",)),
    ("gfdl", ("gfdl-1.1", "gfdl-1.2", "gfdl-1.3"), ("gnu free documentation",), ("gnu.org/licenses/fdl",)),
    ("bsd", ("bsd",), ("bsd", "berkeley software distribution"), ()),
    ("0bsd", ("0bsd",), ("zero[- ]clause bsd", "0bsd"), ("opensource.org/licenses/0bsd",)),
    ("bsd-2-clause", ("bsd-2-clause",), ("simplified bsd", "freebsd", "bsd 2[- ]clause", "2[- ]clause bsd"), ("opensource.org/licenses/bsd-2-clause",)),
    ("bsd-3-clause", ("bsd-3-clause",), ("new bsd", "modified bsd", "revised bsd", "bsd 3[- ]clause", "3[- ]clause bsd"), ("opensource.org/licenses/bsd-3-clause",)),
    ("bsd-4-clause", ("bsd-4-clause",), ("original bsd", "bsd 4[- ]clause", "4[- ]clause bsd"), ()),
    ("isc", ("isc",), ("isc",), ("opensource.org/licenses/isc",)),
    ("mpl", ("mpl",), ("mozilla public", "mpl"), ("mozilla.org/mpl",)),
    ("mpl-1.1", ("mpl-1.1",), (r"mozilla public license,? (?:version )?1\.1",), ("mozilla.org/mpl/1.1",)),
    ("mpl-2.0", ("mpl-2.0",), (r"mozilla public license,? (?:version |v\. ?)?2\.0", r"mpl ?v?2(?:\.0)?"), ("mozilla.org/mpl/2.0",)),
    ("epl-1.0", ("epl-1.0",), ("eclipse public", r"eclipse public license,? (?:version |v)?1\.0"), ("eclipse.org/legal/epl-v10",)),
    ("epl-2.0", ("epl-2.0",), (r"eclipse public license,? (?:version |v)?2\.0",), ("eclipse.org/legal/epl-2.0", "eclipse.org/legal/epl-v20")),
    ("cddl-1.0", ("cddl-1.0", "cddl-1.1"), ("common development and distribution", "cddl"), ("opensource.org/licenses/cddl",)),
    ("cpl-1.0", ("cpl-1.0",), ("common public",), ("opensource.org/licenses/cpl",)),
    ("ms-pl", ("ms-pl",), ("microsoft public",), ("opensource.org/licenses/ms-pl",)),
    ("ms-rl", ("ms-rl",), ("microsoft reciprocal",), ()),
    ("artistic-1.0", ("artistic-1.0",), (r"artistic license,? (?:version )?1\.0",), ()),
    ("artistic-2.0", ("artistic-2.0",), ("artistic", r"artistic license,? (?:version )?2\.0"), ("opensource.org/licenses/artistic-license-2.0",)),
    ("bsl-1.0", ("bsl-1.0",), ("boost software",), ("boost.org/license",)),
    ("zlib", ("zlib",), ("zlib", "zlib/libpng"), ("opensource.org/licenses/zlib",)),
    ("unlicense", ("unlicense",), ("the unlicense", "unlicense"), ("unlicense.org",)),
    ("wtfpl", ("wtfpl",), ("wtfpl",), ("wtfpl.net",)),
    ("cc0-1.0", ("cc0-1.0",), ("cc0", r"cc0 1\.0", "creative commons zero"), ("creativecommons.org/publicdomain/zero",)),
    ("cc-by", ("cc-by-1.0", "cc-by-2.0", "cc-by-3.0", "cc-by-4.0"), (r"cc[- ]by(?: \d\.0)?", r"creative commons attribution(?: \d\.0)?"), ("creativecommons.org/licenses/by/",)),
    ("cc-by-sa", ("cc-by-sa-2.0", "cc-by-sa-3.0", "cc-by-sa-4.0"), (r"cc[- ]by[- ]sa(?: \d\.0)?", r"creative commons attribution[- ]share-?alike(?: \d\.0)?"), ("creativecommons.org/licenses/by-sa",)),
    ("cc-by-nd", ("cc-by-nd-3.0", "cc-by-nd-4.0"), (r"cc[- ]by[- ]nd(?: \d\.0)?", r"creative commons attribution[- ]no-?deriv\w+(?: \d\.0)?"), ("creativecommons.org/licenses/by-nd",)),
    ("cc-by-nc", ("cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0"), (r"cc[- ]by[- ]nc(?: \d\.0)?", r"creative commons attribution[- ]non-?commercial(?: \d\.0)?"), ("creativecommons.org/licenses/by-nc/",)),
    ("cc-by-nc-sa", ("cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"), (r"cc[- ]by[- ]nc[- ]sa(?: \d\.0)?",), ("creativecommons.org/licenses/by-nc-sa",)),
    ("cc-by-nc-nd", ("cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"), (r"cc[- ]by[- ]nc[- ]nd(?: \d\.0)?",), ("creativecommons.org/licenses/by-nc-nd",)),
    ("eupl", ("eupl-1.1", "eupl-1.2"), ("european union public", "eupl"), ()),
    ("osl-3.0", ("osl-3.0",), ("open software",), ("opensource.org/licenses/osl-3.0",)),
    ("ofl-1.1", ("ofl-1.1",), ("sil open font", "open font"), ("scripts.sil.org/ofl",)),
    ("odbl-1.0", ("odbl-1.0",), ("open database", "odbl"), ("opendatacommons.org/licenses/odbl",)),
    ("pddl-1.0", ("pddl-1.0",), ("public domain dedication",), ("opendatacommons.org/licenses/pddl",)),
    ("psf-2.0", ("psf-2.0", "python-2.0"), ("python software foundation", "psf"), ("docs.python.org/license",)),
    ("postgresql", ("postgresql",), ("postgresql",), ("opensource.org/licenses/postgresql",)),
    ("ruby", ("ruby",), ("ruby",), ()),
    ("php-3.01", ("php-3.0", "php-3.01"), ("php",), ("php.net/license",)),
    ("openssl", ("openssl",), ("openssl",), ()),
    ("ncsa", ("ncsa",), ("university of illinois/ncsa",), ("opensource.org/licenses/ncsa",)),
)
#: Clauses and notices, written by hand: label and pattern.  A space is any white space and comment marks.
SIGNATURES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", r"to deal in the software without restriction"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("x11", r"the name of the x consortium shall not be used in advertising"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"the above copyright notice and this permission notice appear in all copies"),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", r"historical permission notice and disclaimer"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"in no event shall the (?:copyright (?:holder|owner)s?|regents|authors?) (?:or|and) contributors be liable"),
    ("bsd-3-clause", r"neither the names? of .{1,120}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", r"this product includes software developed by the university of california"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("openssl", r"this product includes cryptographic software written by eric young"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", r"you may not use this (?:file|software|work) except in compliance with the license"),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an"),
    ("apache-2.0", r"terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", r"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) license"),
    ("gpl", r"this (?:program|software|file|package) is free software[;:,] you can redistribute it and/or modify it"),
    ("gpl", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", r"you should have received a copy of the gnu general public license"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl-2.0", r"either version 2 of the license, or \(at your option\) any later version"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", r"free software foundation,? inc\., (?:51 franklin|59 temple place|675 mass ave)"),
    ("gpl-3.0", r"either version 3 of the license, or \(at your option\) any later version"),
    ("gpl-3.0", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-3.0", r"protecting users' legal rights from anti-circumvention law"),
    ("gpl-linking-exception", r"linking this (?:library|program) statically or dynamically with other modules"),
    ("gpl-linking-exception", r"as a special exception, the copyright holders? (?:of this library )?give you permission to link"),
    ("classpath-exception-2.0", r"classpath exception"),
    ("gcc-exception-3.1", r"gcc runtime library exception"),
    ("autoconf-exception", r"contains a configuration script generated by autoconf"),
    ("bison-exception-2.2", r"create a larger work that contains part or all of the bison parser skeleton"),
    ("llvm-exception", r"llvm exceptions? to the apache"),
    ("openssl-exception", r"permission to link the (?:code|program) .{1,120}? with the openssl"),
    ("lgpl", r"this library is free software[;:,] you can redistribute it and/or modify it"),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public license as published by"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", r"either version 2\.1 of the license, or \(at your option\) any later version"),
    ("agpl-3.0", r"under the terms of the gnu affero general public license as published by"),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", r"the gnu affero general public license is a free, copyleft license"),
    ("agpl-3.0", r"users interacting with it remotely through a computer network"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2.0", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl", r"software distributed under the license is distributed on an .as is. basis, without warranty of any kind, either express or implied"),
    ("npl-1.1", r"netscape public license"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?\.? ?2\.0"),
    ("epl-2.0", r"this source code may also be made available under the following secondary licenses"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", r"ibm public license"),
    ("lpl-1.02", r"lucent public license"),
    ("cc-by", r"this work is licensed under (?:a|the) creative commons attribution (?:\d\.0 )?(?:international|unported|generic)"),
    ("cc-by-sa", r"this work is licensed under (?:a|the) creative commons attribution-share ?alike"),
    ("cc-by-nc", r"this work is licensed under (?:a|the) creative commons attribution-non-?commercial (?:\d\.0|international|unported|license)"),
    ("cc-by-nc-sa", r"creative commons attribution-non-?commercial-share ?alike"),
    ("cc-by-nc-nd", r"creative commons attribution-non-?commercial-no-?deriv(?:ative)?s?"),
    ("cc-by-nd", r"this work is licensed under (?:a|the) creative commons attribution-no-?deriv(?:ative)?s?"),
    ("cc", r"creative commons corporation .{0,40}?is not a law firm and does not provide legal services"),
    ("cc", r"some rights reserved"),
    ("cc0-1.0", r"to the extent possible under law, .{1,120}? has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", r"(?:released|placed|dedicated|put) (?:in)?to the public domain"),
    ("public-domain", r"(?:this|the) (?:work|file|code|software|text|image|document) is in the public domain"),
    ("public-domain", r"no copyright is claimed"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", r"do what the f(?:uck|\*ck) you want to public license"),
    ("beerware", r"the beer-ware license"),
    ("beerware", r"you can buy me a beer in return"),
    ("json", r"the software shall be used for good, not evil"),
    ("zlib", r"this software is provided .as-is., without any express or implied warranty"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("zlib", r"this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", r"to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied"),
    ("perl", r"(?:it|you) (?:and/or|can|may) (?:re)?distribute (?:it )?(?:and/or modify it )?under the same terms as perl itself"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("php-3.01", r"this product includes php software, freely available from"),
    ("psf-2.0", r"psf is making python available to licensee on an .as is. basis"),
    ("psf-2.0", r"this license agreement is between the python software foundation"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", r"to any person obtaining a copy of the font software"),
    ("bitstream-vera", r"bitstream vera is a trademark of bitstream"),
    ("ncsa", r"neither the names of .{1,120}?, nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ms-pl", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("ms-eula", r"microsoft software license terms"),
    ("eupl-1.2", r"european union public licen[cs]e v\.? ?1\.2"),
    ("cecill", r"cecill(?:-[abc])? (?:free software )?licen[cs]e"),
    ("afl-3.0", r"academic free license"),
    ("apsl-2.0", r"apple public source license"),
    ("cpal-1.0", r"common public attribution license"),
    ("qpl-1.0", r"q public license"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("vim", r"vim is charityware"),
    ("imagemagick", r"imagemagick studio"),
    ("info-zip", r"info-zip license"),
    ("curl", r"the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("libpng", r"the png reference library is supplied .as is."),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", r"portions of this software are copyright .{1,80}? the freetype project"),
    ("upl-1.0", r"universal permissive license"),
    ("w3c", r"w3c (?:software|document) (?:notice|license|and document)"),
    ("unicode", r"unicode,? inc\. license agreement"),
    ("zpl-2.1", r"zope public license"),
    ("ecl-2.0", r"educational community license"),
    ("rpl-1.5", r"reciprocal public license"),
    ("watcom-1.0", r"sybase open watcom public license"),
    ("nasa-1.3", r"nasa open source agreement"),
    ("intel", r"intel open source license"),
    ("nvidia", r"nvidia (?:software )?license agreement"),
    ("oracle-bcl", r"oracle binary code license agreement"),
    ("oracle-otn", r"oracle technology network license agreement"),
    ("mulanpsl-2.0", r"mulan (?:psl|permissive software license)"),
    ("blueoak-1.0.0", r"blue oak model license"),
    ("hippocratic", r"hippocratic license"),
    ("anti-996", r"anti-? ?996 license"),
    ("parity", r"parity public license"),
    ("prosperity", r"prosperity public license"),
    ("polyform-noncommercial", r"polyform noncommercial license"),
    ("polyform", r"polyform (?:small business|strict|shield|perimeter|free trial|internal use) license"),
    ("sspl-1.0", r"server side public license"),
    ("busl-1.1", r"business source license"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("elastic-2.0", r"elastic license"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"commons clause license condition"),
    ("confluent", r"confluent community license"),
    ("redis", r"redis source available license"),
    ("openrail", r"open ?rail-?[mds]?(?:\+\+-m)? license"),
    ("openrail", r"use-based restrictions as referenced in paragraph"),
    ("llama", r"llama \d(?:\.\d)? community license agreement"),
    ("odc-by", r"open data commons attribution license"),
    ("odbl-1.0", r"this database is made available under the open database license"),
    ("cdla", r"community data license agreement"),
    ("ogl-uk-3.0", r"open government licen[cs]e"),
    ("etalab-2.0", r"licence ouverte"),
    ("free-art", r"free art license"),
    ("free-art", r"licence art libre"),
    ("opl-1.0", r"open publication license"),
    ("opencontent", r"opencontent license"),
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"confidential and proprietary"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"unauthorized (?:copying|reproduction|use|distribution|disclosure) .{0,120}?strictly prohibited"),
    ("proprietary", r"end-? ?user license agreement"),
    ("proprietary", r"no part of this (?:publication|book|document|work|material) may be reproduced"),
    ("proprietary", r"may not be (?:copied|reproduced|distributed|disclosed)(?:,? [a-z]+){0,8},? without (?:the )?(?:prior|express) written (?:permission|consent)"),
    ("proprietary", r"for evaluation purposes only"),
    ("proprietary", r"contains? trade secrets"),
    ("proprietary", r"this software is licensed, not sold"),
    ("proprietary", r"reverse-? ?engineer, decompile,? or disassemble"),
    ("notice", r"without warrant(?:y|ies) of any kind"),
    ("notice", r"permission is hereby granted"),
    ("notice", r"copyright (?:(?:\(c\)|©) ?)?\d{4}"),
    ("notice", r"see (?:the )?(?:accompanying )?licen[sc]e file"),
    ("notice", r"(?:see|read) copying for details"),
    ("notice", r"licen[sc]e agreement"),
    ("notice", r"terms of (?:the|this) licen[sc]e"),
    ("notice", r"licen[sc]ed under\b"),
)
#: form: priority and weight in the score.
FORMS = {"identifier": (100, 0.99), "address": (90, 0.95), "clause": (88, 0.95), "field": (85, 0.9), "grant": (80, 0.9), "title": (60, 0.6), "claim": (50, 0.6), "notice": (10, 0.2)}
#: What a space of a signature stands for: white space and marks of comments.
GAP = r"[\s*#/;|>-]+"


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    pattern: str
    keywords: tuple[str, ...]


def keywords(pattern: str, n: int = 2) -> tuple[str, ...]:
    """The n longest words that every match of a pattern holds: those outside of groups, classes and options."""
    plain = re.sub(r"\\[a-zA-Z]", " ", pattern)  # classes and bounds
    while (less := re.sub(r"\((?:\?[:!=]|\?<!)?[^()]*\)[?*]?(?:\{[^}]*\})?", " ", re.sub(r"\\[()]", " ", plain))) != plain:
        plain = less
    plain = re.sub(r"\[(?:\\.|[^\]])*\][?*+]?", " ", plain)
    plain = re.sub(r"(?:\\?.)[?*]|\{[^}]*\}", " ", plain)
    words = re.findall(r"[a-z0-9]+", plain)
    return tuple(sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))[:n])


def _rule(label: str, form: str, pattern: str) -> Rule:
    return Rule(label, form, pattern, keywords(pattern))


def rules() -> list[Rule]:
    """All rules, in order of priority."""
    out = []
    for label, text in (*SIGNATURES, *CLAUSES):
        form = {"notice": "notice", "proprietary": "claim"}.get(label, "clause")
        out.append(Rule(label, form, rf"(?<![\w-]){text.replace(' ?', '@').replace(' ', GAP).replace('@', '(?:' + GAP + ')?')}", keywords(text)))
    for label, ids, names, urls in FAMILIES:
        for i in ids:
            out.append(_rule(label, "identifier", rf"spdx-license-identifier:\s*\(?{re.escape(i)}(?![\w.+-])"))
            out.append(_rule(label, "field", rf"\blicen[sc]e[\"']?\s*[:=]\s*[\"']?{re.escape(i)}(?![\w.+-])"))
        for url in urls:
            out.append(Rule(label, "address", rf"(?:https?://)?(?:www\.)?{re.escape(url)}[\w./-]*", (url,)))
        for name in names:
            spaced = name.replace(" ?", "@").replace(" ", r"\s+").replace("@", r"\s*")
            ended = "" if "license" in name else r"(?:\s+(?:public\s+)?licen[sc]e)?"
            out.append(_rule(label, "grant", rf"\b(?:licen[sc]ed|released|distributed|available|provided|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{spaced}{ended}(?![\w-])"))
            needed = "" if "license" in name else r"\s+(?:public\s+)?licen[sc]e"
            out.append(_rule(label, "title", rf"\b{spaced}{needed}(?![\w-])"))
    return sorted(dict.fromkeys(out), key=lambda r: (-FORMS[r.form][0], r.label, r.pattern))


class Intervals:
    """Accepted intervals of which none contains another: begins ascend, and so do ends."""

    def __init__(self):
        self.begin: list[int] = []
        self.end: list[int] = []

    def hold(self, a: int, b: int) -> bool:
        at = bisect_right(self.begin, a) - 1
        return at >= 0 and self.end[at] >= b

    def add(self, a: int, b: int) -> None:
        at = bisect_right(self.begin, a)
        if at and self.begin[at - 1] == a:
            at -= 1
        upto = bisect_right(self.end, b)  # those that begin later and end no later lie within
        self.begin[at : max(at, upto)], self.end[at : max(at, upto)] = [a], [b]


class Scanner:
    """Compiled rules behind a keyword automaton."""

    _made: list = []

    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.compiled = [re.compile(r.pattern, re.DOTALL) for r in self.rules]
        #: rules by their first keyword; the others are asked for afterwards
        self.by_word: dict[str, list[int]] = {}
        self.words = ahocorasick.Automaton()
        for i, r in enumerate(self.rules):
            self.by_word.setdefault(r.keywords[0], []).append(i)
            for word in r.keywords:
                self.words.add_word(word, word)
        self.words.make_automaton()

    @classmethod
    def get(cls) -> "Scanner":
        if not cls._made:
            cls._made.append(cls())
        return cls._made[0]

    def live(self, low: str) -> list[int]:
        """The rules all of whose keywords the text holds."""
        found = {word for _, word in self.words.iter(low)}
        return [i for word in found if word in self.by_word for i in self.by_word[word] if all(k in found for k in self.rules[i].keywords)]

    def detections(self, low: str) -> list[tuple[int, int, Rule]]:
        """(begin, end, rule) of what remains, in order of place."""
        spans = [(*m.span(), i) for i in self.live(low) for m in self.compiled[i].finditer(low)]
        spans.sort(key=lambda x: (-FORMS[self.rules[x[2]].form][0], x[0] - x[1], x[0], self.rules[x[2]].label, x[2]))
        kept, held = [], Intervals()
        for a, b, i in spans:
            if not held.hold(a, b):
                held.add(a, b)
                kept.append((a, b, i))
        return [(a, b, self.rules[i]) for a, b, i in sorted(kept)]


def base_places(low: str) -> list[tuple[int, str]]:
    """(first word, label) of each place where a base phrase's words stand in succession."""
    if "license" not in low:
        return []
    words = _WORD.findall(low)
    out = []
    for k, word in enumerate(words):
        if word == "license":
            for phrase, label in BASE:
                want = phrase.split()
                if k + 1 >= len(want) and words[k + 1 - len(want) : k + 1] == want:
                    out.append((k + 1 - len(want), label))
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<begin:int,end:int,label:string,form:string>>"


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and those of SCHEMA.  Detections count letters of the text."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    columns = [c for c in docs.columns if c != text and c not in names]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in columns)
    detected = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("form", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.get()
        for batch in batches:
            for a, b in slices(batch, text):
                part = batch.slice(a, b - a)
                column = part.column(len(columns))
                buf, bounds = joined_bytes(column)
                n_words = np.diff(word_bounds(buf, bounds, BREAKS)[2])
                rows = []
                for value in column.to_pylist():
                    low = value.encode().lower().decode() if value else ""
                    places, found = base_places(low), scanner.detections(low)
                    base = sorted({x for _, x in places})
                    miss = 1.0
                    for weight in {r.label: FORMS[r.form][1] for _, _, r in reversed(found)}.values():
                        miss *= 1 - weight
                    if places:
                        miss *= 0.5
                    rows.append((len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *(r.label for _, _, r in found)})), 1 - miss, [{"begin": x, "end": y, "label": r.label, "form": r.form} for x, y, r in found]))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), detected]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(n_words, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], [*columns, *names])

    return small_batches(docs).select(*[f"`{c}`" for c in [*columns, text]]).mapInArrow(run, fields + SCHEMA)
