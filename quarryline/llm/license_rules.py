"""The ordered signature rules of the license scan.

A rule is a pattern over a text's words: lower case, joined by single spaces, so `\\b`-like edges are spaces. Rules
are written by hand as forms (how texts speak of a license) and licenses (their names and identifiers); each
form that suits a license makes one rule, whose priority is the form's. Whole notices, longest and surest, come first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """keywords: words that a text must hold, one of each group, before the pattern is tried."""

    number: int
    label: str
    kind: str
    priority: int
    weight: float
    keywords: tuple[tuple[bytes, ...], ...]
    pattern: re.Pattern[bytes]
    base: bool = False


#: Phrases whose every place counts, and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, name as a pattern over words, words of which a text must hold one, identifiers as in package files.
LICENSES = (
    ("agpl-3.0", r"(?:gnu )?affero general public licen[cs]e(?: version 3(?: 0)?| v ?3(?: 0)?)?|agpl ?v?3?", ("affero", "agpl", "agplv", "agplv3", "agpl3"), ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?: as published by the free software foundation)? ?(?:version|v) ?2(?: [01])?|lgpl ?v?2(?: [01])?", ("lesser", "library", "lgpl", "lgplv2", "lgpl2"), ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 2 0")),
    ("lgpl-3.0", r"(?:gnu )?lesser general public licen[cs]e ?(?:version|v) ?3(?: 0)?|lgpl ?v?3(?: 0)?", ("lesser", "lgpl", "lgplv3", "lgpl3"), ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")),
    ("lgpl", r"(?:gnu )?lesser general public licen[cs]e|lgpl", ("lesser", "lgpl"), ("lgpl",)),
    ("gpl-2.0", r"(?:gnu )?general public licen[cs]e ?(?:version|v) ?2(?: 0)?|gpl ?v?2(?: 0)?", ("public", "gpl", "gplv2", "gpl2"), ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later")),
    ("gpl-3.0", r"(?:gnu )?general public licen[cs]e ?(?:version|v) ?3(?: 0)?|gpl ?v?3(?: 0)?", ("public", "gpl", "gplv3", "gpl3"), ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl|gpl", ("public", "gpl"), ("gpl",)),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl", ("documentation", "gfdl"), ("gfdl 1 3", "gfdl 1 2", "gfdl 1 1")),
    ("apache-1.1", r"apache (?:software )?licen[cs]e ?(?:version|v)? ?1 [01]", ("apache",), ("apache 1 1", "apache 1 0")),
    ("apache-2.0", r"apache (?:software )?licen[cs]e ?(?:version|v)? ?2(?: 0)?|apache 2(?: 0)?|asl 2 0", ("apache", "asl"), ("apache 2 0",)),
    ("apache", r"apache (?:software )?licen[cs]e", ("apache",), ("apache",)),
    ("mit", r"(?:mit|expat|x11)(?: x11| expat)?(?: style)? licen[cs]e", ("mit", "expat", "x11"), ("mit", "x11", "mit 0")),
    ("bsd-2-clause", r"(?:simplified |freebsd )bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|2 clause bsd licen[cs]e", ("bsd", "freebsd"), ("bsd 2 clause",)),
    ("bsd-3-clause", r"(?:new |revised |modified )bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?|3 clause bsd licen[cs]e", ("bsd",), ("bsd 3 clause",)),
    ("bsd-4-clause", r"(?:original |old )bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?", ("bsd",), ("bsd 4 clause",)),
    ("bsd", r"bsd(?: style)? licen[cs]e", ("bsd",), ("bsd", "0bsd")),
    ("isc", r"isc licen[cs]e", ("isc",), ("isc",)),
    ("mpl-1.1", r"mozilla public licen[cs]e ?(?:version|v)? ?1 [01]|mpl ?1 [01]", ("mozilla", "mpl", "mpl1"), ("mpl 1 1", "mpl 1 0")),
    ("mpl-2.0", r"mozilla public licen[cs]e ?(?:version|v)? ?2(?: 0)?|mpl ?2 0", ("mozilla", "mpl", "mpl2"), ("mpl 2 0",)),
    ("mpl", r"mozilla public licen[cs]e", ("mozilla",), ("mpl",)),
    ("epl-1.0", r"eclipse public licen[cs]e ?(?:version|v)? ?1(?: 0)?", ("eclipse",), ("epl 1 0",)),
    ("epl-2.0", r"eclipse public licen[cs]e ?(?:version|v)? ?2(?: 0)?", ("eclipse",), ("epl 2 0",)),
    ("epl", r"eclipse public licen[cs]e", ("eclipse",), ("epl",)),
    ("cddl", r"common development and distribution licen[cs]e|cddl", ("cddl", "distribution"), ("cddl 1 0", "cddl 1 1")),
    ("cpl", r"common public licen[cs]e", ("common",), ("cpl 1 0",)),
    ("ipl", r"ibm public licen[cs]e", ("ibm",), ("ipl 1 0",)),
    ("eupl", r"european union public licen[cs]e|eupl", ("european", "eupl"), ("eupl 1 1", "eupl 1 2")),
    ("artistic-2.0", r"artistic licen[cs]e ?(?:version|v)? ?2(?: 0)?", ("artistic",), ("artistic 2 0",)),
    ("artistic", r"artistic licen[cs]e", ("artistic",), ("artistic 1 0",)),
    ("perl", r"same terms as perl(?: itself)?", ("perl",), ("artistic 1 0 or gpl 1 0",)),
    ("python", r"python (?:software foundation )?licen[cs]e|psf licen[cs]e", ("python", "psf"), ("python 2 0", "psf 2 0")),
    ("ruby", r"ruby licen[cs]e", ("ruby",), ("ruby",)),
    ("php", r"php licen[cs]e", ("php",), ("php 3 0", "php 3 01")),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", ("zlib",), ("zlib",)),
    ("boost", r"boost software licen[cs]e", ("boost",), ("bsl 1 0",)),
    ("openssl", r"openssl licen[cs]e", ("openssl",), ("openssl",)),
    ("curl", r"curl licen[cs]e", ("curl",), ("curl",)),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", ("wtfpl", "fuck"), ("wtfpl",)),
    ("unlicense", r"the unlicen[cs]e|unlicen[cs]e", ("unlicense", "unlicence"), ("unlicense",)),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", ("microsoft", "ms"), ("ms pl",)),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", ("microsoft",), ("ms rl",)),
    ("ofl", r"(?:sil )?open font licen[cs]e", ("font",), ("ofl 1 1", "ofl 1 0")),
    ("odbl", r"open (?:data commons )?(?:open )?database licen[cs]e|odbl", ("database", "odbl"), ("odbl 1 0",)),
    ("osl", r"open software licen[cs]e", ("software",), ("osl 3 0",)),
    ("afl", r"academic free licen[cs]e", ("academic",), ("afl 3 0",)),
    ("upl", r"universal permissive licen[cs]e", ("universal",), ("upl 1 0",)),
    ("bsl", r"business source licen[cs]e|busl 1 1", ("business", "busl"), ("busl 1 1",)),
    ("sspl", r"server side public licen[cs]e|sspl", ("sspl", "server"), ("sspl 1 0",)),
    ("elastic", r"elastic licen[cs]e(?: 2 0)?", ("elastic",), ("elastic 2 0",)),
    ("cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?|creative commons zero", ("cc0", "zero"), ("cc0 1 0",)),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [0-9])?|(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", ("nd", "noderiv", "noderivs", "noderivative", "noderivatives", "derivs", "derivatives", "deriv", "derivative"), ("cc by nc nd 3 0", "cc by nc nd 4 0")),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [0-9])?|(?:creative commons )?attribution non ?commercial share ?alike", ("sa", "sharealike", "alike"), ("cc by nc sa 3 0", "cc by nc sa 4 0")),
    ("cc-by-nc", r"cc by nc(?: [1-4] [0-9])?|(?:creative commons )?attribution non ?commercial", ("nc", "noncommercial", "commercial"), ("cc by nc 3 0", "cc by nc 4 0")),
    ("cc-by-nd", r"cc by nd(?: [1-4] [0-9])?|(?:creative commons )?attribution no ?deriv(?:ative)?s?(?: works)?", ("nd", "noderiv", "noderivs", "noderivative", "noderivatives", "derivs", "derivatives", "deriv", "derivative"), ("cc by nd 3 0", "cc by nd 4 0")),
    ("cc-by-sa", r"cc by sa(?: [1-4] [0-9])?|(?:creative commons )?attribution share ?alike", ("sa", "sharealike", "alike"), ("cc by sa 3 0", "cc by sa 4 0")),
    ("cc-by", r"cc by(?: [1-4] [0-9])?|creative commons attribution", ("by", "attribution"), ("cc by 3 0", "cc by 4 0")),
    ("public-domain", r"public domain", ("domain",), ("public domain", "cc pddc")),
    ("proprietary", r"proprietary licen[cs]e|commercial licen[cs]e", ("proprietary", "commercial"), ("proprietary", "licenseref proprietary")),
)

#: kind, what stands before and after the name, words of which a text must hold one, priority, weight.
FORMS = (
    ("grant", r"(?:is |are |be )?(?:re)?licen[cs]ed (?:to you )?(?:under|by|with) (?:the )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?(?: version [1-4](?: [0-9])?)?", ("licensed", "licenced", "relicensed", "relicenced"), 60, 0.95),
    ("release", r"(?:released|distributed|published|made available|available|redistributed|provided) (?:freely )?under (?:the )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?(?: version [1-4](?: [0-9])?)?", ("released", "distributed", "published", "available", "redistributed", "provided"), 55, 0.9),
    ("terms", r"(?:under|by|subject to|accept|accordance with) the terms (?:and conditions )?of (?:the )?", r"", ("terms",), 50, 0.85),
    ("field", r"licen[cs]e (?:is |type |name |id |expression )?(?:the )?", r"(?= |$)", ("license", "licence"), 40, 0.7),
    ("copy", r"copy of (?:the )?", r"", ("copy",), 35, 0.6),
    ("see", r"(?:see|refer to|read) (?:the )?(?:file )?", r"(?: for (?:more )?(?:details|information))", ("see", "refer", "read"), 30, 0.6),
)

#: Passages of the licenses themselves and other notices: label, pattern, words of which a text must hold one, priority, weight.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby", 100, 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", 90, 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee", 100, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution", 100, 1.0),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions", 80, 0.8),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,20}?nor the names of (?:its|their) contributors may be used to endorse or promote products", "endorse", 90, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", 95, 0.95),
    ("apache-2.0", r"you may not use this (?:file|software|work) except in compliance with the licen[cs]e", "compliance", 90, 0.9),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "basis", 95, 0.95),
    ("apache-2.0", r"apache org licen[cs]es licen[cs]e 2 0", "apache", 85, 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute", 100, 1.0),
    ("gpl-2.0", r"either version 2 of the licen[cs]e or (?:at your option )?any later version", "version", 85, 0.9),
    ("gpl-3.0", r"either version 3 of the licen[cs]e or (?:at your option )?any later version", "version", 85, 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", "library", 100, 1.0),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "mozilla", 100, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "implied", 85, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 100, 1.0),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "organization", 100, 1.0),
    ("cc-by-sa", r"creativecommons org licen[cs]es by sa", "creativecommons", 90, 0.95),
    ("cc-by-nc", r"creativecommons org licen[cs]es by nc(?= [0-9])", "creativecommons", 90, 0.95),
    ("cc-by-nc-sa", r"creativecommons org licen[cs]es by nc sa", "creativecommons", 91, 0.95),
    ("cc-by-nc-nd", r"creativecommons org licen[cs]es by nc nd", "creativecommons", 91, 0.95),
    ("cc-by-nd", r"creativecommons org licen[cs]es by nd", "creativecommons", 90, 0.95),
    ("cc-by", r"creativecommons org licen[cs]es by(?= [0-9])", "creativecommons", 89, 0.95),
    ("cc0", r"creativecommons org publicdomain zero", "creativecommons", 90, 0.95),
    ("public-domain", r"(?:is|are|been|placed|dedicated) (?:in|into|to) the public domain", "domain", 60, 0.8),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies", "sublicense|sublicence", 95, 0.95),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability", 88, 0.85),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "holders", 86, 0.85),
    ("mit", r"this (?:project|package|code|software|work|repository|library) is mit licen[cs]ed", "mit", 62, 0.95),
    ("mit", r"dual licen[cs]ed (?:under )?(?:the )?mit (?:licen[cs]e )?(?:or|and) (?:the )?(?:apache|gpl|bsd)", "dual", 66, 0.9),
    ("x11", r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}?shall not be used in advertising", "advertising", 96, 0.95),
    ("hpnd", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "fee", 100, 1.0),
    ("hpnd", r"makes no representations about the suitability of this software for any purpose", "suitability", 80, 0.8),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "fee", 100, 1.0),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims", 92, 0.95),
    ("isc", r"in no event shall the author be liable for any special direct indirect or consequential damages", "consequential", 85, 0.8),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "fee", 100, 1.0),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "reproduce", 85, 0.85),
    ("bsd", r"this software is provided by (?:the )?(?:copyright holders and contributors|regents and contributors|authors?) as is and any express or implied warranties", "warranties", 90, 0.9),
    ("bsd", r"in no event shall the (?:copyright (?:holders?|owner)|regents|authors?) or contributors be liable", "contributors", 84, 0.85),
    ("bsd", r"the regents of the university of california", "regents", 45, 0.5),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors", "conclusions", 87, 0.9),
    ("bsd-2-clause-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual worldwide", "receiving", 97, 1.0),
    ("bsd-3-clause-clear", r"no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e", "patent", 97, 1.0),
    ("apache-2.0", r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "asf", 97, 1.0),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e", "irrevocable", 97, 1.0),
    ("apache-2.0", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e", "governing", 94, 0.95),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution", "reproduction", 80, 0.8),
    ("apache-1.1", r"this product includes software developed by the apache (?:software foundation|group)", "apache", 95, 0.95),
    ("apache-1.1", r"products derived from this software may not be called apache nor may apache appear in their name", "apache", 96, 1.0),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "hope", 92, 0.95),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e along with this (?:program|software|file|package)", "received", 93, 0.95),
    ("gpl", r"the licen[cs]es for most software (?:and other practical works )?are designed to take away your freedom to share and change", "freedom", 100, 1.0),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", "verbatim", 90, 0.9),
    ("gpl-2.0", r"gnu general public licen[cs]e version 2 june 1991", "june", 101, 1.0),
    ("gpl-3.0", r"gnu general public licen[cs]e version 3 29 june 2007", "june", 101, 1.0),
    ("gpl-2.0", r"under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?v?2 only", "only", 76, 0.95),
    ("lgpl-2.0", r"gnu library general public licen[cs]e version 2 june 1991", "june", 101, 1.0),
    ("lgpl-2.1", r"gnu lesser general public licen[cs]e version 2 1 february 1999", "february", 101, 1.0),
    ("lgpl-3.0", r"gnu lesser general public licen[cs]e version 3 29 june 2007", "june", 101, 1.0),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "received", 95, 0.95),
    ("lgpl", r"this library is distributed in the hope that it will be useful", "hope", 93, 0.95),
    ("agpl-3.0", r"gnu affero general public licen[cs]e version 3 19 november 2007", "november", 101, 1.0),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public licen[cs]e", "affero", 96, 1.0),
    ("agpl-3.0", r"if your software can interact with users remotely through a (?:computer )?network", "remotely", 95, 0.95),
    ("gpl-classpath", r"permission to link this library with independent modules to produce an executable", "executable", 97, 0.95),
    ("gpl-classpath", r"classpath exception", "classpath", 70, 0.9),
    ("gcc-exception", r"gcc runtime library exception", "gcc", 82, 0.95),
    ("gpl-openssl", r"permission to link (?:the code of )?(?:portions of )?this program with (?:the )?openssl", "openssl", 90, 0.95),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "documentation", 100, 1.0),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant", 95, 0.95),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 99, 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mozilla", 100, 1.0),
    ("mpl-1.1", r"see the licen[cs]e for the specific language governing rights and limitations under the licen[cs]e", "governing", 93, 0.85),
    ("npl", r"netscape public licen[cs]e", "netscape", 60, 0.9),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v ?1 0", "eclipse", 100, 1.0),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0", "eclipse", 100, 1.0),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "distribution", 100, 1.0),
    ("cpl", r"the accompanying program is provided under the terms of this common public licen[cs]e", "accompanying", 100, 1.0),
    ("eupl", r"licen[cs]ed under the eupl", "eupl", 80, 0.95),
    ("cecill", r"governed by the cecill(?: [abc])? licen[cs]e under french law", "cecill", 100, 1.0),
    ("cecill", r"cecill(?: [abc])? licen[cs]e", "cecill", 50, 0.8),
    ("cc-by", r"this (?:work|article) is licen[cs]ed under (?:a|the) creative commons attribution(?: [1-4] [0-9])? international", "attribution", 88, 0.95),
    ("cc-by", r"open access article distributed under the (?:terms of the )?creative commons attribution licen[cs]e", "access", 90, 0.95),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike", "available", 90, 0.95),
    ("cc0", r"to the extent possible under law (?:[^ ]+ ){1,12}?has waived all copyright and related or neighboring rights", "waived", 100, 1.0),
    ("cc0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "affirmer", 100, 1.0),
    ("creative-commons", r"some rights reserved", "reserved", 25, 0.5),
    ("pddl", r"open data commons public domain dedication and licen[cs]e", "dedication", 95, 1.0),
    ("odc-by", r"open data commons attribution licen[cs]e", "attribution", 85, 0.95),
    ("odbl", r"which is made available here under the open database licen[cs]e", "database", 100, 1.0),
    ("odbl", r"openstreetmap contributors", "openstreetmap", 40, 0.5),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile", 98, 1.0),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate", "jurisdictions", 98, 1.0),
    ("public-domain", r"this (?:file|code|software|work) (?:has been|is|was) (?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain", "domain", 85, 0.95),
    ("public-domain", r"no rights reserved", "reserved", 30, 0.6),
    ("public-domain", r"work of the (?:u s|united states) government", "government", 60, 0.7),
    ("public-domain", r"gemeinfrei(?:es werk)?", "gemeinfrei|gemeinfreies", 40, 0.6),
    ("blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", "blessing", 100, 1.0),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", 95, 0.95),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document", "verbatim", 91, 0.95),
    ("beerware", r"if we meet some ?day and you think this stuff is worth it you can buy me a beer", "beer", 100, 1.0),
    ("json", r"the software shall be used for good not evil", "evil", 100, 1.0),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented", 98, 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", "altered", 97, 0.95),
    ("libpng", r"the png reference library is supplied as is", "png", 97, 1.0),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg", 97, 1.0),
    ("freetype", r"portions of this software are copyright (?:[^ ]+ ){1,8}?the freetype project", "freetype", 97, 1.0),
    ("boost", r"distributed under the boost software licen[cs]e version 1 0", "boost", 99, 1.0),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 100, 1.0),
    ("openssl", r"this product includes cryptographic software written by eric young", "cryptographic", 100, 1.0),
    ("python", r"this licen[cs]e agreement is between the python software foundation psf", "psf", 100, 1.0),
    ("php", r"this product includes php software freely available from", "php", 100, 1.0),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", "redistribute", 96, 0.95),
    ("perl", r"you can redistribute it and or modify it under the same terms as perl", "perl", 96, 1.0),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "intent", 100, 1.0),
    ("vim", r"vim is charityware you can use and copy it as much as you like", "charityware", 100, 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "fee", 101, 1.0),
    ("w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e", "w3c", 88, 0.95),
    ("unicode", r"unicode (?:inc )?licen[cs]e agreement data files and software", "unicode", 95, 1.0),
    ("ofl", r"this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1", "sil", 100, 1.0),
    ("ofl", r"the fonts and derivatives however cannot be released under any other type of licen[cs]e", "fonts", 98, 1.0),
    ("ofl", r"with reserved font name", "font", 70, 0.85),
    ("bsl", r"change date (?:[^ ]+ ){1,6}?change licen[cs]e", "change", 75, 0.8),
    ("bsl", r"additional use grant", "grant", 60, 0.7),
    ("sspl", r"making the functionality of the program or (?:a )?modified version available to third parties as a service", "functionality", 99, 1.0),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted", 100, 1.0),
    ("commons-clause", r"commons clause licen[cs]e condition", "clause", 95, 1.0),
    ("polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial) licen[cs]e", "polyform", 95, 1.0),
    ("openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: [msd])?(?: licen[cs]e)?", "openrail|rail", 55, 0.85),
    ("llama", r"llama (?:[2-4](?: [0-9])? )?community licen[cs]e", "llama", 85, 0.95),
    ("gemma", r"gemma terms of use", "gemma", 85, 0.95),
    ("ms-eula", r"microsoft software licen[cs]e terms", "microsoft", 85, 0.95),
    ("oracle", r"oracle (?:binary code|technology network) licen[cs]e", "oracle", 88, 0.95),
    ("intel", r"intel simplified software licen[cs]e", "intel", 88, 0.95),
    ("nvidia", r"nvidia (?:software|source code) licen[cs]e", "nvidia", 88, 0.95),
    ("eula", r"end user licen[cs]e agreement", "agreement", 50, 0.75),
    ("eula", r"by (?:installing|using|downloading|clicking) (?:[^ ]+ ){1,12}?you (?:agree|accept) (?:to be bound by|the terms)", "agree|accept", 42, 0.6),
    ("proprietary", r"no part of this (?:publication|book|document|work|site|website) may be (?:reproduced|copied|transmitted|distributed)", "part", 75, 0.85),
    ("proprietary", r"this material may not be published broadcast rewritten or redistributed", "rewritten", 90, 0.95),
    ("proprietary", r"reproduction (?:in whole or in part )?(?:without (?:written )?permission )?is (?:strictly )?prohibited", "prohibited", 64, 0.8),
    ("proprietary", r"without (?:the )?(?:prior )?(?:express )?written (?:permission|consent) of", "written", 32, 0.5),
    ("proprietary", r"contains (?:valuable )?trade secrets of", "trade", 55, 0.7),
    ("proprietary", r"nachdruck (?:auch auszugsweise )?(?:nur )?mit genehmigung", "nachdruck", 62, 0.8),
    ("proprietary", r"reproduction (?:m\xc3\xaame partielle )?interdite", "interdite", 62, 0.8),
    ("proprietary", r"prohibida (?:la |su )?reproducci\xc3\xb3n", "prohibida", 62, 0.8),
    ("all-rights-reserved", r"all rights reserved", "reserved", 20, 0.5),
    ("all-rights-reserved", r"alle rechte vorbehalten", "vorbehalten", 20, 0.5),
    ("all-rights-reserved", r"tous droits r\xc3\xa9serv\xc3\xa9s", "droits", 20, 0.5),
    ("all-rights-reserved", r"todos los derechos reservados", "derechos", 20, 0.5),
    ("copyright-notice", r"copyright (?:c |\xc2\xa9 )?(?:19|20)[0-9][0-9]", "copyright", 15, 0.4),
    ("proprietary", r"(?:strictly )?(?:confidential and proprietary|proprietary and confidential)", "proprietary", 60, 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:[^ ]+ ){0,8}?(?:is )?(?:strictly )?prohibited", "prohibited", 60, 0.8),
)


def _compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<![^ ])(?:" + pattern.encode("latin-1") + rb")(?![^ ])", re.DOTALL)


def _words(*words: str) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in words if w)


def build_rules() -> tuple[Rule, ...]:
    """All rules, surest first; of equal priority, in the order they are written."""
    found: list[tuple] = []
    for phrase, label in BASE:
        found.append((label, "base", 45, 0.8, tuple((w.encode(),) for w in phrase.split()), _compiled(phrase), True))
    for label, pattern, word, priority, weight in NOTICES:
        found.append((label, "notice", priority, weight, (_words(*word.split("|")),), _compiled(pattern), False))
    for label, name, words, ids in LICENSES:
        for kind, before, after, gate, priority, weight in FORMS:
            pattern = _compiled(f"{before}(?:{name}){after}")
            found.append((label, kind, priority, weight, (_words(*words), _words(*gate)), pattern, False))
        spdx = "|".join(sorted(ids, key=len, reverse=True))
        found.append((label, "spdx", 70, 1.0, ((b"spdx",),), _compiled(f"spdx licen[cs]e identifier (?:{spdx})"), False))
        if label not in ("mit", "cc-by", "public-domain", "proprietary", "perl"):
            found.append((label, "name", 25, 0.5, (_words(*words),), _compiled(name), False))
    found.sort(key=lambda x: -x[2])
    return tuple(Rule(i, x[0], x[1], x[2], x[3], tuple(k for k in x[4] if k), x[5], x[6]) for i, x in enumerate(found))
