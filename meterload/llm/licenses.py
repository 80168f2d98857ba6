"""License scan: ordered signature rules over normalised words, with keyword gates and span suppression.

A text is lower-cased (A-Z) and cut into words of ASCII letters, digits and any character beyond ASCII; the words
joined by one space are what rules see. A rule is a regular expression with a label, a priority and a keyword that
every match contains. One pass of plain substring searches for the few keywords decides which rules run at all, so
most texts never meet a regular expression. Rules are names of licenses, and sentences of their texts, notices, headers
and exceptions. What stands before a name (an SPDX tag, "licensed under the terms of") belongs to its detection and
raises its priority and score; a name that is denied ("not licensed under the") is no detection.

Detections are resolved in order of priority, then length, then place: one that lies within the words of an
accepted detection is suppressed ("version 2 of the gnu general public license" keeps the specific label alone).

Base phrases are fixed: all places where their words stand consecutively, overlapping ones included. Their labels
always stay. score is the confidence of the best accepted detection, 0 without one.

Defined cases: a null text counts as empty: no words, no places, empty labels, null first and last word. Rows are
independent; repeated rows get equal results; other columns are not read. Whole texts are scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import as_bytes, map_arrow

#: Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str  # over words joined by one space; matches begin and end at word bounds
    keyword: str  # plain text that every match contains
    priority: int  # higher first
    score: float
    named: bool = False  # a name, before which a lead may stand


#: Names of licenses as they are written, by label.
_NAMES = {
    "gpl-1.0": [r"gnu general public license v(?:ersion )?1(?: 0)?", r"gpl v?1(?: 0)?"],
    "gpl-2.0": [r"gnu general public license v(?:ersion )?2(?: 0)?", r"gnu gpl v?(?:ersion )?2(?: 0)?", r"gplv2", r"gpl v?2(?: 0)?"],
    "gpl-3.0": [r"gnu general public license v(?:ersion )?3(?: 0)?", r"gnu gpl v?(?:ersion )?3(?: 0)?", r"gplv3", r"gpl v?3(?: 0)?"],
    "lgpl-2.0": [r"gnu library general public license(?: v(?:ersion )?2(?: 0)?)?", r"lgpl v?2 0"],
    "lgpl-2.1": [r"gnu lesser general public license v(?:ersion )?2 1", r"lgplv2 1", r"lgpl v?2 1"],
    "lgpl-3.0": [r"gnu lesser general public license v(?:ersion )?3(?: 0)?", r"lgplv3", r"lgpl v?3(?: 0)?"],
    "agpl-3.0": [r"gnu affero general public license(?: v(?:ersion )?3(?: 0)?)?", r"agplv3", r"agpl v?3(?: 0)?"],
    "gfdl-1.3": [r"gnu free documentation license(?: v(?:ersion )?1 [123])?", r"gfdl 1 [123]"],
    "apache-1.1": [r"apache software license v(?:ersion )?1 1", r"apache license v(?:ersion )?1 1"],
    "apache-2.0": [r"apache (?:software )?license v(?:ersion )?2(?: 0)?", r"apache (?:license )?2 0", r"apache2 license"],
    "mit": [r"mit license", r"mit x11 license", r"expat license", r"x11 license"],
    "mit-0": [r"mit no attribution(?: license)?", r"mit 0 license"],
    "bsd-2-clause": [r"bsd 2 clause(?: simplified)?(?: license)?", r"2 clause bsd(?: license)?", r"simplified bsd license", r"freebsd license"],
    "bsd-3-clause": [r"bsd 3 clause(?: new)?(?: or revised)?(?: license)?", r"3 clause bsd(?: license)?", r"(?:new|revised|modified) bsd license"],
    "bsd-4-clause": [r"bsd 4 clause(?: license)?", r"original bsd license"],
    "0bsd": [r"0bsd(?: license)?", r"bsd zero clause license", r"zero clause bsd(?: license)?"],
    "isc": [r"isc license"],
    "mpl-1.1": [r"mozilla public license v(?:ersion )?1 1", r"mpl 1 1"],
    "mpl-2.0": [r"mozilla public license v?(?:ersion )?2(?: 0)?", r"mpl v?2(?: 0)?"],
    "epl-1.0": [r"eclipse public license v(?:ersion )?1(?: 0)?", r"epl 1 0"],
    "epl-2.0": [r"eclipse public license v(?:ersion )?2(?: 0)?", r"epl 2 0"],
    "cddl-1.0": [r"common development and distribution license(?: v(?:ersion )?1(?: [01])?)?", r"cddl 1 [01]"],
    "cpl-1.0": [r"common public license(?: v(?:ersion )?1(?: 0)?)?"],
    "eupl-1.2": [r"european union public licen[cs]e(?: v(?:ersion )?1 [12])?", r"eupl 1 [12]"],
    "artistic-2.0": [r"artistic license(?: v?(?:ersion )?2(?: 0)?)?"],
    "zlib": [r"zlib(?: libpng)? license"],
    "libpng": [r"libpng license"],
    "boost-1.0": [r"boost software license(?: v?(?:ersion )?1(?: 0)?)?", r"bsl 1 0"],
    "bsl-1.1": [r"business source license(?: 1 1)?", r"bsl 1 1"],
    "sspl-1.0": [r"server side public license(?: v(?:ersion )?1)?"],
    "elastic-2.0": [r"elastic license(?: 2 0)?"],
    "unlicense": [r"the unlicense", r"unlicense org"],
    "wtfpl": [r"wtfpl", r"do what the fuck you want to public license"],
    "cc0-1.0": [r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero(?: v1 0)?"],
    "cc-by-2.0": [r"cc by 2 0", r"creative commons attribution 2 0"],
    "cc-by-3.0": [r"cc by 3 0", r"creative commons attribution 3 0"],
    "cc-by-4.0": [r"cc by 4 0", r"creative commons attribution 4 0"],
    "cc-by-sa-2.0": [r"cc by sa 2 0", r"creative commons attribution sharealike 2 0"],
    "cc-by-sa-3.0": [r"cc by sa 3 0", r"creative commons attribution share ?alike 3 0"],
    "cc-by-sa-4.0": [r"cc by sa 4 0", r"creative commons attribution share ?alike 4 0"],
    "cc-by-nc-3.0": [r"cc by nc 3 0", r"creative commons attribution non ?commercial 3 0"],
    "cc-by-nc-4.0": [r"cc by nc 4 0", r"creative commons attribution non ?commercial 4 0"],
    "cc-by-nd-3.0": [r"cc by nd 3 0", r"creative commons attribution no ?deriv(?:ative)?s 3 0"],
    "cc-by-nd-4.0": [r"cc by nd 4 0", r"creative commons attribution no ?deriv(?:ative)?s 4 0"],
    "cc-by-nc-sa-3.0": [r"cc by nc sa 3 0", r"creative commons attribution non ?commercial share ?alike 3 0"],
    "cc-by-nc-sa-4.0": [r"cc by nc sa 4 0", r"creative commons attribution non ?commercial share ?alike 4 0"],
    "cc-by-nc-nd-4.0": [r"cc by nc nd 4 0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0"],
    "ofl-1.1": [r"sil open font license(?: v(?:ersion )?1 1)?", r"ofl 1 1"],
    "odbl-1.0": [r"open database license(?: v1 0)?", r"odbl(?: v?1 0)?"],
    "ms-pl": [r"microsoft public license", r"ms pl"],
    "ms-rl": [r"microsoft reciprocal license", r"ms rl"],
    "psf-2.0": [r"python software foundation license(?: v(?:ersion )?2)?", r"psf license"],
    "php-3.01": [r"php license(?: v(?:ersion )?3 01)?"],
    "postgresql": [r"postgresql licen[cs]e"],
    "ruby": [r"ruby license"],
    "openssl": [r"openssl license"],
    "vim": [r"vim license"],
    "w3c": [r"w3c (?:software )?(?:notice and )?license"],
    "upl-1.0": [r"universal permissive license(?: v(?:ersion )?1(?: 0)?)?"],
    "ncsa": [r"university of illinois ncsa open source license", r"ncsa license"],
    "afl-3.0": [r"academic free license(?: v(?:ersion )?3(?: 0)?)?"],
    "osl-3.0": [r"open software license(?: v(?:ersion )?3(?: 0)?)?"],
    "json": [r"json license"],
    "beerware": [r"beer ?ware license"],
}

#: More names: older, national, source-available, data and model licenses.
_MORE_NAMES = {
    "apsl-2.0": [r"apple public source license(?: v(?:ersion )?2(?: 0)?)?"],
    "aladdin": [r"aladdin free public license"],
    "artistic-1.0": [r"artistic license v?(?:ersion )?1(?: 0)?", r"clarified artistic license"],
    "blueoak-1.0.0": [r"blue oak model license(?: 1 0 0)?"],
    "bigscience-openrail-m": [r"bigscience (?:bloom )?(?:open)?rail(?: m)?(?: license)?"],
    "cal-1.0": [r"cryptographic autonomy license(?: version 1 0)?"],
    "catosl-1.1": [r"computer associates trusted open source license(?: 1 1)?"],
    "cc-pddc": [r"creative commons public domain dedication"],
    "cc-pdm-1.0": [r"creative commons public domain mark(?: 1 0)?"],
    "cc-sampling-plus": [r"creative commons sampling plus"],
    "cdla-permissive-2.0": [r"community data license agreement permissive(?: v(?:ersion )?2 0)?"],
    "cdla-sharing-1.0": [r"community data license agreement sharing(?: v(?:ersion )?1 0)?"],
    "cecill-2.1": [r"cecill(?: v(?:ersion )?2(?: [01])?)? license", r"cecill free software license agreement"],
    "cecill-b": [r"cecill b(?: license)?"],
    "cecill-c": [r"cecill c(?: license)?"],
    "commons-clause": [r"commons clause license condition", r"commons clause v?1 0"],
    "cpal-1.0": [r"common public attribution license(?: v(?:ersion )?1 0)?"],
    "cua-opl": [r"cua office public license"],
    "creativeml-openrail-m": [r"creativeml open ?rail(?: m)?(?: license)?"],
    "curl": [r"curl license"],
    "d-fsl-1.0": [r"deutsche freie software lizenz"],
    "ecl-2.0": [r"educational community license(?: v(?:ersion )?2 0)?"],
    "edl-1.0": [r"eclipse distribution license(?: v(?:ersion )?1 0)?"],
    "efl-2.0": [r"eiffel forum license(?: v(?:ersion )?[12])?"],
    "entessa": [r"entessa public license"],
    "etalab-2.0": [r"licence ouverte(?: open licen[cs]e)?(?: 2 0)?", r"etalab 2 0"],
    "fair": [r"fair license"],
    "fal-1.3": [r"free art license(?: 1 3)?", r"licence art libre(?: 1 3)?"],
    "fsl-1.1": [r"functional source license(?: v(?:ersion )?1 1)?"],
    "ftl": [r"freetype (?:project )?license"],
    "gemma": [r"gemma terms of use"],
    "hippocratic-2.1": [r"hippocratic license(?: 2 1)?"],
    "hpnd": [r"historical permission notice and disclaimer"],
    "ibm-pl": [r"ibm public license(?: v(?:ersion )?1 0)?"],
    "icu": [r"icu license"],
    "ijg": [r"independent jpeg group license"],
    "imagemagick": [r"imagemagick license"],
    "intel": [r"intel open source license"],
    "ipa": [r"ipa font license"],
    "llama-2": [r"llama 2 community license(?: agreement)?"],
    "llama-3": [r"(?:meta )?llama 3(?: [123])? community license(?: agreement)?"],
    "lppl-1.3c": [r"latex project public license(?: v(?:ersion )?1 3c?)?", r"lppl(?: v(?:ersion )?1 3c?)?"],
    "lucent": [r"lucent public license"],
    "miros": [r"miros licen[cs]e"],
    "motosoto": [r"motosoto open source license"],
    "mulan-psl-2.0": [r"mulan psl v2", r"mulan permissive software license(?: v(?:ersion )?2)?"],
    "nasa-1.3": [r"nasa open source agreement(?: v(?:ersion )?1 3)?"],
    "naumen": [r"naumen public license"],
    "nethack": [r"nethack general public license"],
    "nokia": [r"nokia open source license"],
    "nposl-3.0": [r"non profit open software license(?: 3 0)?"],
    "ntp": [r"ntp license"],
    "oclc-2.0": [r"oclc research public license(?: 2 0)?"],
    "odc-by-1.0": [r"open data commons attribution license(?: v1 0)?", r"odc by(?: 1 0)?"],
    "ogl-uk-3.0": [r"open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?"],
    "openldap": [r"openldap public license(?: v(?:ersion )?2 8)?"],
    "openrail": [r"open responsible ai license"],
    "oset-pl": [r"oset (?:foundation )?public license"],
    "parity-7.0.0": [r"parity public license(?: 7 0 0)?"],
    "pddl-1.0": [r"public domain dedication and license", r"odc pddl(?: 1 0)?"],
    "polyform-noncommercial": [r"polyform noncommercial license(?: 1 0 0)?"],
    "polyform-small-business": [r"polyform small business license(?: 1 0 0)?"],
    "prosperity-3.0.0": [r"prosperity public license(?: 3 0 0)?"],
    "qpl-1.0": [r"q public license(?: v(?:ersion )?1 0)?"],
    "rpl-1.5": [r"reciprocal public license(?: 1 5)?"],
    "rpsl": [r"realnetworks public source license"],
    "rscpl": [r"ricoh source code public license"],
    "simpl-2.0": [r"simple public license(?: 2 0)?"],
    "sissl": [r"sun industry standards source license"],
    "sleepycat": [r"sleepycat license"],
    "spl-1.0": [r"sun public license(?: v(?:ersion )?1 0)?"],
    "tcl": [r"tcl tk license"],
    "ucl-1.0": [r"upstream compatibility license"],
    "unicode": [r"unicode license(?: v3)?", r"unicode inc license agreement"],
    "vsl-1.0": [r"vovida software license"],
    "watcom": [r"sybase open watcom public license"],
    "wxwindows": [r"wxwindows library licen[cs]e"],
    "xnet": [r"x net license"],
    "zpl-2.1": [r"zope public license(?: v(?:ersion )?2 [01])?", r"zpl 2 [01]"],
}

#: What may stand before a name, and the priority and score that it gives: the more is said, the surer it is.
_LEADS = (
    ("spdx", r"spdx license identifier ", 90, 1.0),
    ("under", r"(?:is |are )?(?:licensed|released|distributed|available|provided|published|offered|made available) under (?:the )?"
              r"(?:terms (?:and conditions )?of (?:the )?)?", 70, 0.95),
    ("kind", r"licen[cs]e ", 60, 0.85),
)
_PLAIN = 50, 0.8
#: What denies a name that follows.
_DENIED = re.compile(
    rb" (?:not|never|nor|neither|no longer|cannot be) (?:(?:be|been|being|is|are|licensed|released|distributed|available|"
    rb"provided|published|covered) )*(?:under |by )?(?:the )?(?:terms (?:and conditions )?of (?:the )?)?$")

#: Sentences of permissive licenses and their notices: label, pattern, priority, score.
_PERMISSIVE = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 80, 0.95),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish", 80, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 78, 0.9),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 74, 0.8),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 74, 0.8),
    ("x11", r"the name of (?:\w+ ){1,6}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 84, 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 80, 0.95),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 79, 0.95),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", 76, 0.85),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", 77, 0.85),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 80, 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions", 76, 0.85),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", 76, 0.85),
    ("bsd-3-clause", r"neither the name of (?:\w+ ){1,8}may be used to endorse or promote products derived from this software", 82, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 84, 0.95),
    ("bsd", r"this software is provided by the (?:\w+ ){1,6}as is and any express or implied warranties", 74, 0.8),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors", 78, 0.85),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 83, 0.95),
    ("apache-2.0", r"you may not use this file except in compliance with the license", 75, 0.9),
    ("apache-2.0", r"you may obtain a copy of the license at http www apache org licenses license 2 0", 82, 1.0),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 76, 0.85),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", 82, 0.95),
    ("apache-2.0", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", 76, 0.85),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 76, 0.8),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 80, 0.95),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 80, 0.95),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 80, 0.9),
    ("libpng", r"the png reference library is supplied as is", 80, 0.95),
    ("boost-1.0", r"distributed under the boost software license version 1 0", 85, 1.0),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 84, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 85, 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 82, 0.95),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies", 75, 0.8),
    ("wtfpl", r"you just do what the fuck you want to", 82, 0.95),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", 82, 0.95),
    ("beerware", r"you can buy me a beer in return", 80, 0.9),
    ("json", r"the software shall be used for good not evil", 86, 1.0),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 84, 0.9),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 84, 0.95),
    ("openssl", r"this product includes cryptographic software written by eric young", 82, 0.9),
    ("php-3.01", r"this product includes php software freely available from http www php net software", 84, 0.95),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 84, 0.95),
    ("ncsa", r"permission is hereby granted free of charge (?:\w+ ){0,12}to deal with the software without restriction", 82, 0.9),
    ("upl-1.0", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", 84, 0.95),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files", 84, 0.95),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", 84, 0.95),
    ("ftl", r"portions of this software are copyright (?:\w+ ){0,6}the freetype project", 84, 0.95),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", 84, 0.95),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", 80, 0.9),
    ("ruby", r"you may make and give away verbatim copies of the source form of this software without restriction", 78, 0.85),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", 80, 0.9),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes", 82, 0.9),
    ("psf-2.0", r"psf hereby grants licensee a nonexclusive royalty free world wide license", 82, 0.95),
    ("ms-pl", r"if you use the software you accept this license if you do not accept the license do not use the software", 80, 0.9),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 80, 0.9),
    ("icu", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:\w+ ){0,40}provided that the above copyright notice s and this permission notice appear", 84, 0.9),
    ("blueoak-1.0.0", r"as far as the law allows this software comes as is without any warranty or condition", 76, 0.7),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software (?:\w+ ){0,45}to permit persons to whom the software is furnished to do so the software is provided", 86, 0.9),
    ("ofl-1.1", r"the fonts and derivatives however cannot be released under any other type of license", 82, 0.95),
    ("ofl-1.1", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", 84, 0.95),
    ("ofl-1.1", r"reserved font name refers to any names specified as such after the copyright statement", 80, 0.9),
)

#: Sentences of reciprocal licenses, with their exceptions.
_RECIPROCAL = (
    ("gpl", r"free software (?:\w+ ){0,4}redistribute it and or modify it under the terms of the gnu general public license", 80, 0.95),
    ("gpl-2.0", r"either version 2 of the license or at your option any later version", 78, 0.85),
    ("gpl-3.0", r"either version 3 of the license or at your option any later version", 78, 0.85),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", 76, 0.85),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", 78, 0.9),
    ("gpl", r"write to the free software foundation inc", 66, 0.75),
    ("gpl", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gnu general public license(?: or later)?", 68, 0.9),
    ("gpl", r"gnu general public license", 40, 0.7),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it", 82, 0.95),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works", 84, 1.0),
    ("gpl-3.0", r"developers that use the gnu gpl protect your rights with two steps", 82, 0.9),
    ("lgpl", r"gnu lesser general public license", 42, 0.7),
    ("lgpl", r"gnu library general public license", 42, 0.7),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 84, 0.95),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library", 82, 0.9),
    ("lgpl-2.1", r"this license the lesser general public license applies to some specially designated software packages", 84, 0.95),
    ("agpl-3.0", r"the gnu affero general public license is a free copyleft license for software", 84, 1.0),
    ("agpl-3.0", r"if you modify the program your modified version must prominently offer all users interacting with it remotely", 84, 0.95),
    ("gfdl-1.3", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 84, 0.95),
    ("gfdl-1.3", r"with no invariant sections no front cover texts and no back cover texts", 80, 0.9),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 84, 0.95),
    ("classpath-exception", r"classpath exception(?: 2 0)?", 62, 0.85),
    ("gcc-exception", r"gcc runtime library exception", 62, 0.9),
    ("autoconf-exception", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf", 84, 0.95),
    ("bison-exception", r"you may create a larger work that contains part or all of the bison parser skeleton", 84, 0.95),
    ("linking-exception", r"as a special exception (?:\w+ ){0,14}permission to link (?:the code of )?(?:\w+ ){0,6}with", 78, 0.8),
    ("openssl-exception", r"gives? permission to link the code of (?:\w+ ){1,6}with the openssl library", 86, 0.95),
    ("syscall-note", r"linux syscall note", 62, 0.9),
    ("llvm-exception", r"llvm exceptions? to the apache 2 0 license", 84, 0.95),
    ("llvm-exception", r"apache license v2 0 with llvm exceptions", 92, 1.0),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", 85, 1.0),
    ("mpl-2.0", r"you can obtain one at https? mozilla org mpl 2 0", 84, 1.0),
    ("mpl-2.0", r"this source code form is incompatible with secondary licenses", 84, 0.95),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 86, 1.0),
    ("mpl-1.1", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language", 72, 0.7),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 86, 1.0),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 86, 1.0),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", 84, 0.95),
    ("cddl-1.0", r"the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license", 86, 0.95),
    ("eupl-1.2", r"licensed under the eupl", 72, 0.9),
    ("osl-3.0", r"licensed under the open software license version 3 0", 86, 1.0),
    ("afl-3.0", r"licensed under the academic free license version 3 0", 86, 1.0),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", 84, 0.95),
    ("cecill-2.1", r"this software is governed by the cecill license under french law", 84, 0.95),
    ("cecill-b", r"this software is governed by the cecill b license under french law", 86, 1.0),
    ("cecill-c", r"this software is governed by the cecill c license under french law", 86, 1.0),
    ("lppl-1.3c", r"this work may be distributed and or modified under the conditions of the latex project public license", 84, 0.95),
    ("qpl-1.0", r"this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license", 84, 0.95),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 84, 0.95),
    ("apsl-2.0", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", 86, 1.0),
    ("nasa-1.3", r"this open source agreement agreement defines the rights of use reproduction distribution modification and redistribution", 84, 0.95),
)

#: Sentences about content, data, models, source-available and closed software.
_OTHER = (
    ("apache", r"apache license", 40, 0.7),
    ("bsd", r"bsd (?:style )?license", 40, 0.6),
    ("cc-by", r"cc by", 40, 0.6),
    ("cc-by-sa", r"cc by sa", 44, 0.7),
    ("cc-by-nc", r"cc by nc", 44, 0.7),
    ("cc-by-nd", r"cc by nd", 44, 0.7),
    ("cc-by-nc-sa", r"cc by nc sa", 46, 0.7),
    ("cc-by-nc-nd", r"cc by nc nd", 46, 0.7),
    ("creative-commons", r"creative commons(?: attribution)?(?: \w+){0,4} licen[cs]e", 42, 0.7),
    ("creative-commons", r"some rights reserved", 30, 0.5),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0", 84, 1.0),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0", 84, 1.0),
    ("cc-by-sa-4.0", r"creativecommons org licenses by sa 4 0", 84, 1.0),
    ("cc-by-sa-3.0", r"creativecommons org licenses by sa 3 0", 84, 1.0),
    ("cc-by-nc-4.0", r"creativecommons org licenses by nc 4 0", 84, 1.0),
    ("cc-by-nd-4.0", r"creativecommons org licenses by nd 4 0", 84, 1.0),
    ("cc-by-nc-sa-4.0", r"creativecommons org licenses by nc sa 4 0", 84, 1.0),
    ("cc-by-nc-nd-4.0", r"creativecommons org licenses by nc nd 4 0", 84, 1.0),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", 84, 1.0),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", 84, 0.95),
    ("cc0-1.0", r"to the extent possible under law (?:\w+ ){1,10}has waived all copyright and related or neighboring rights", 84, 0.95),
    ("cc-by-4.0", r"you are free to share copy and redistribute the material in any medium or format", 66, 0.7),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license", 72, 0.8),
    ("cc-by-nc", r"you may not use the material for commercial purposes", 72, 0.8),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", 72, 0.8),
    ("cc-by-sa-3.0", r"text is available under the creative commons attribution sharealike license", 80, 0.9),
    ("odbl-1.0", r"this (?:\w+ ){0,4}is made available under the open database license", 84, 0.95),
    ("odc-by-1.0", r"is made available under the open data commons attribution license", 84, 0.95),
    ("odbl-1.0", r"openstreetmap contributors", 34, 0.5),
    ("ogl-uk-3.0", r"contains public sector information licensed under the open government licence", 84, 0.95),
    ("us-government-work", r"this is a work of the (?:u s|united states) government", 80, 0.9),
    ("us-government-work", r"not subject to copyright protection in the united states", 78, 0.85),
    ("crown-copyright", r"crown copyright(?: (?:19|20)\d\d)?", 56, 0.7),
    ("public-domain", r"(?:released|dedicated|placed) (?:in)?to the public domain", 60, 0.8),
    ("public-domain", r"(?:is |are )in the public domain", 55, 0.7),
    ("public-domain", r"no copyright is claimed", 60, 0.7),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", 84, 0.95),
    ("bsl-1.1", r"effective on the change date or the fourth anniversary of the first publicly available distribution", 84, 0.95),
    ("bsl-1.1", r"additional use grant", 46, 0.6),
    ("commons-clause", r"the license does not grant to you the right to sell the software", 84, 0.95),
    ("polyform-noncommercial", r"any noncommercial purpose is a permitted purpose", 84, 0.95),
    ("llama-2", r"llama 2 is licensed under the llama 2 community license", 86, 1.0),
    ("llama-3", r"built with (?:meta )?llama 3", 60, 0.8),
    ("openrail", r"use based restrictions as referenced in paragraph 5", 80, 0.85),
    ("research-only", r"for (?:academic |non commercial )?research (?:purposes|use) only", 60, 0.7),
    ("non-commercial", r"for (?:personal and )?non ?commercial use only", 60, 0.75),
    ("evaluation-only", r"for evaluation purposes only", 56, 0.7),
    ("eula", r"end user licen[cs]e agreement", 56, 0.75),
    ("eula", r"by installing (?:copying )?or (?:otherwise )?using the software you agree to be bound", 72, 0.85),
    ("eula", r"you may not reverse engineer decompile or disassemble", 72, 0.85),
    ("proprietary", r"all rights reserved", 20, 0.4),
    ("proprietary", r"proprietary and confidential", 60, 0.8),
    ("proprietary", r"confidential and proprietary", 60, 0.8),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", 80, 0.95),
    ("proprietary", r"no part of this (?:publication|book|work|document) may be reproduced", 76, 0.9),
    ("proprietary", r"this software contains (?:trade secrets|proprietary information) of", 76, 0.9),
    ("proprietary", r"may not be (?:reproduced|copied|redistributed) without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", 74, 0.85),
    ("proprietary", r"(?:reproduction|redistribution) in whole or in part without (?:written )?permission is prohibited", 76, 0.9),
    ("press-agency", r"this material may not be published broadcast rewritten or redistributed", 80, 0.9),
    ("permission", r"reprinted with permission", 46, 0.6),
    ("permission", r"used (?:with|by) permission", 40, 0.5),
    ("copyright", r"copyright c? ?(?:19|20)\d\d", 10, 0.3),
)


def _keyword(pattern: str) -> str:
    """The longest plain run of words of a pattern; every match contains it."""
    plain = re.sub(r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)(?:\?|\{[^}]*\})?|\[[^\]]*\]\??|\\.|.\?", "|", pattern)
    return max((p.strip() for p in plain.split("|")), key=len)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in the order in which they are resolved."""
    out = [Rule(label, pattern, _keyword(pattern), priority, score)
           for label, pattern, priority, score in (*_PERMISSIVE, *_RECIPROCAL, *_OTHER)]
    out += [Rule(label, name, _keyword(name), *_PLAIN, named=True)
            for names in (_NAMES, _MORE_NAMES) for label, patterns in names.items() for name in patterns]
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern)))


@lru_cache(maxsize=1)
def _compiled() -> tuple[tuple[bytes, tuple[tuple[dict[str | None, Rule], re.Pattern], ...]], ...]:
    """By keyword: rules as they are after each lead (None: without one), and their patterns."""
    by_keyword: dict[str, list] = {}
    leads = "|".join(f"(?P<{name}>{pattern})" for name, pattern, _, _ in _LEADS)
    for rule in rules():
        pattern, after = rule.pattern, {None: rule}
        if rule.named:
            pattern = f"(?:{leads})?(?:{pattern})(?: only| or later)?"
            after |= {name: replace(rule, priority=priority, score=score) for name, _, priority, score in _LEADS}
        by_keyword.setdefault(rule.keyword, []).append((after, re.compile(rf"(?<= )(?:{pattern})(?= )".encode())))
    return tuple((k.encode(), tuple(v)) for k, v in by_keyword.items())


@lru_cache(maxsize=1)
def _gates() -> tuple[bytes, ...]:
    """Keywords that contain no other one: a text without these has no match."""
    keys = [k for k, _ in _compiled()]
    return tuple(k for k in keys if not any(o != k and o in k for o in keys))


_SPLIT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def normalise(text: bytes | None) -> tuple[bytes, int]:
    """The words joined by one space, with one at both ends, and their number."""
    words = text.translate(_SPLIT).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b" ", len(words)


def detections(line: bytes) -> Iterator[tuple[Rule, int, int]]:
    """(rule, start, end) of all matches in a normalised text, as byte offsets."""
    if any(g in line for g in _gates()):
        for keyword, entries in _compiled():
            if keyword in line:
                for after, pattern in entries:
                    for m in pattern.finditer(line):
                        if not _DENIED.search(line, max(0, m.start() - 120), m.start()):
                            yield after[m.lastgroup], m.start(), m.end()


def resolve(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Accepted detections: none lies within one accepted before it."""
    accepted: list[tuple[Rule, int, int]] = []
    reach: dict[int, list[tuple[int, int]]] = {}  # accepted spans by the blocks of 1,024 bytes that they touch
    for rule, a, b in sorted(found, key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].label)):
        if not any(x <= a and b <= y for x, y in reach.get(a >> 10, ())):
            accepted.append((rule, a, b))
            for block in range(a >> 10, (b >> 10) + 1):
                reach.setdefault(block, []).append((a, b))
    return accepted


def scan(text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, accepted detections of one text."""
    line, n_words = normalise(text)
    starts, base = [], set()
    for phrase, label in BASE:
        look = f" {phrase} ".encode()
        at = line.find(look)
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = line.find(look, at + 1)
    accepted = resolve(list(detections(line)))
    first = line.count(b" ", 0, min(starts)) if starts else None
    last = line.count(b" ", 0, max(starts)) if starts else None
    labels = base | {rule.label for rule, _, _ in accepted}
    spans, word, at = [], 0, 0
    for rule, a, b in sorted(accepted, key=lambda d: (d[1], d[2], d[0].label)):
        word, at = word + line.count(b" ", at, a), a
        spans.append({"label": rule.label, "first_word": word - 1, "n_words": line.count(b" ", a, b) + 1,
                      "priority": rule.priority, "score": rule.score})
    return (n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
            max((rule.score for rule, _, _ in accepted), default=0.0), spans)


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "array<struct<label: string, first_word: long, n_words: long, priority: int, score: double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: COLUMNS and `spans`, the accepted detections in words from 0."""
    names = [c.split()[0] for c in COLUMNS.split(", ")[1:]] + ["spans"]

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        found = [scan(t) for t in as_bytes(batch, "text")]
        return {"doc_id": batch.column("doc_id")} | {n: [f[i] for f in found] for i, n in enumerate(names)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, f"{COLUMNS}, spans {SPANS}")
