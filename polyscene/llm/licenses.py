"""License scans with ordered signature rules.

A signature is a hand-written expression with a label, a kind and keywords. Kinds are
ordered by how much they prove: passages of the license itself, the standard header, an
SPDX tag, an address, a sentence that grants it, a name with its version, a bare name.
A signature runs only on texts that hold one of its keywords. Of overlapping detections,
one whose interval lies within another's is dropped if the other's kind comes first, or
if of the same kind the other signature stands earlier in the list. So the header of a
text that names a license takes the place of the bare name in it.

In the expressions a blank stands for white space and the marks of comment lines, ~ for
the same or nothing, and % for up to 1500 characters.

Base phrases are looked up by words besides; their labels always stay.

Defined results: a null text is empty: no words, null places, no labels, score 0; rows
that repeat a doc_id are scanned each; of two detections of one interval and kind the
earlier signature's stays; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, map_texts

#: Phrases and their labels (fixed values of the contract).
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Kinds, the strongest first, and their scores.
KINDS = {"text": 1.0, "header": 1.0, "spdx": 1.0, "url": 0.9, "grant": 0.95, "version": 0.8, "name": 0.6}

#: label, kind, keywords (any of them), expression over lower-case text.
SIGNATURES = [
    # MIT and its relatives
    ("mit", "text", "free of charge", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this (?:software|font software)(?: and associated documentation files)?"),
    ("mit", "text", "substantial portions", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("mit", "text", "sublicense", r"to deal in the software without restriction,? including without limitation the rights to use,? copy,? modify,? merge,? publish,? distribute,? sublicense"),
    ("mit-0", "text", "free of charge", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files%to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("x11", "text", "x consortium", r"except as contained in this notice,? the name of the x consortium shall not be used in advertising"),
    ("mit", "header", "mit", r"use of this source code is governed by an? mit(?: |-)(?:style )?licen[cs]e"),
    ("mit", "url", "licenses/mit", r"opensource\.org/licenses/mit(?:-license)?"),
    ("mit", "grant", "mit expat", r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat|x11)(?:/x11)?(?: |-)licen[cs]e"),
    ("mit", "grant", "mit", r"(?:is|are) mit(?: |-)licen[cs]ed"),
    ("mit", "name", "mit expat", r"(?<![a-z0-9])(?:mit|expat)(?:/x11)?(?: |-)licen[cs]e(?![a-z])"),
    ("isc", "text", "and/or distribute", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice"),
    ("isc", "text", "and distribute", r"permission to use,? copy,? modify,? and distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice"),
    ("0bsd", "text", "and/or distribute", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted\."),
    ("isc", "grant", "isc", r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e"),
    ("isc", "name", "isc", r"(?<![a-z0-9])isc licen[cs]e(?![a-z])"),
    ("ntp", "text", "suitability of this software", r"makes? no representations about the suitability of this software for any purpose"),
    # BSD
    ("bsd-4-clause", "text", "advertising materials", r"redistribution and use in source and binary forms%all advertising materials mentioning features or use of this software must display the following acknowledge?ment%neither the name%endorse or promote products(?: derived from this software)?"),
    ("bsd-3-clause", "text", "redistribution and use", r"redistribution and use in source and binary forms%(?:neither the names? of|the names? of the (?:author|contributor)s? may not|my name,? \S+,? may not)%(?:endorse or promote|endorse and promote) products(?: derived from this software)?"),
    ("bsd-2-clause", "text", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met%redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "text", "endorse or promote", r"neither the names? of .{1,200}? may be used to endorse or promote products derived from this software"),
    ("bsd-2-clause", "text", "redistributions of source", r"redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer"),
    ("bsd", "text", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd", "header", "bsd", r"use of this source code is governed by a bsd(?: |-)(?:style |type )?licen[cs]e"),
    ("bsd-3-clause", "url", "bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", "url", "bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd", "grant", "bsd", r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the |an? )?(?:new |modified |simplified |revised |original )?bsd(?:(?: |-)style)?(?: |-)licen[cs]e"),
    ("bsd-2-clause", "version", "bsd", r"(?:(?:2|two)(?: |-)clause bsd|bsd(?: |-)(?:2|two)(?: |-)clause|simplified bsd|freebsd)(?:(?: |-)licen[cs]e)?(?![a-z])"),
    ("bsd-3-clause", "version", "bsd", r"(?:(?:3|three)(?: |-)clause bsd|bsd(?: |-)(?:3|three)(?: |-)clause|(?:new|modified|revised) bsd)(?:(?: |-)licen[cs]e)?(?![a-z])"),
    ("bsd-4-clause", "version", "bsd", r"(?:(?:4|four)(?: |-)clause bsd|bsd(?: |-)(?:4|four)(?: |-)clause|original bsd)(?:(?: |-)licen[cs]e)?(?![a-z])"),
    ("bsd", "name", "bsd", r"(?<![a-z0-9])bsd(?: |-)licen[cs]e(?![a-z])"),
    # Apache
    ("apache-2.0", "text", "apache license", r"apache license version 2\.0,? january 2004"),
    ("apache-2.0", "text", "derivative works", r"subject to the terms and conditions of this license,? each contributor hereby grants to you a perpetual,? worldwide,? non-exclusive,? no-charge,? royalty-free,? irrevocable copyright license"),
    ("apache-1.1", "text", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "header", "apache license", r"licensed under the apache license,? version 2\.0 \(the [\"“']+license[\"”']+\)[;,]? you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", "header", "apache license", r"(?:contributor license agreements|asf licenses this file) .{0,200}?under the apache license,? version 2\.0"),
    ("apache-2.0", "url", "license-2.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "url", "license-1.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "grant", "apache", r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?:,? licen[cs]e)?,?~(?:version |v~|v\.~)?2(?:\.0)?(?![0-9])"),
    ("apache", "grant", "apache", r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e"),
    ("apache-2.0", "version", "apache", r"apache(?: software)? licen[cs]e,?~(?:\(?version |v~|v\.~)?2(?:\.0)?(?![0-9])|apache(?: |-)2(?:\.0)? licen[cs]e|(?<![a-z])asl~2\.0"),
    ("apache-1.1", "version", "apache", r"apache(?: software)? licen[cs]e,?~(?:version |v~)?1\.1"),
    ("apache", "name", "apache", r"(?<![a-z0-9])apache(?: software)? licen[cs]e(?![a-z])"),
    # GNU
    ("agpl-3.0", "text", "affero", r"gnu affero general public license version 3,? 19 november 2007"),
    ("lgpl-3.0", "text", "lesser", r"gnu lesser general public license version 3,? 29 june 2007"),
    ("lgpl-2.1", "text", "lesser", r"gnu lesser general public license version 2\.1,? february 1999"),
    ("lgpl-2.0", "text", "library", r"gnu library general public license version 2,? june 1991"),
    ("gpl-3.0", "text", "general public", r"gnu general public license version 3,? 29 june 2007"),
    ("gpl-2.0", "text", "general public", r"gnu general public license version 2,? june 1991"),
    ("gpl-1.0", "text", "general public", r"gnu general public license version 1,? february 1989"),
    ("gpl-3.0", "text", "copyleft", r"the gnu general public license is a free,? copyleft license for software and other kinds of works"),
    ("agpl-3.0", "text", "affero", r"the gnu affero general public license is a free,? copyleft license for software and other kinds of works,? specifically designed to ensure cooperation with the community"),
    ("gpl-2.0", "text", "designed to take away", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gfdl", "text", "free documentation", r"permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("agpl-3.0", "header", "affero", r"(?:redistribute it and/or )?modify(?: it)? under the terms of the gnu affero general public license(?:,? version 3)? as published by the free software foundation[,;]? (?:either )?version 3"),
    ("lgpl-3.0", "header", "lesser", r"(?:redistribute it and/or )?modify(?: it)? under the terms of the gnu lesser general public license(?: \(lgpl\))? as published by the free software foundation[,;]? (?:either )?version 3"),
    ("lgpl-2.1", "header", "lesser", r"(?:redistribute it and/or )?modify(?: it)? under the terms of the gnu lesser general public license(?: \(lgpl\))? as published by the free software foundation[,;]? (?:either )?version 2\.1"),
    ("lgpl-2.0", "header", "library", r"(?:redistribute it and/or )?modify(?: it)? under the terms of the gnu library general public license as published by the free software foundation[,;]? (?:either )?version 2"),
    ("gpl-3.0", "header", "general public", r"(?:redistribute it and/or )?modify(?: it)? under the terms of the gnu general public license as published by the free software foundation[,;]? (?:either )?version 3"),
    ("gpl-2.0", "header", "general public", r"(?:redistribute it and/or )?modify(?: it)? under the terms of the gnu general public license(?: version 2)? as published by the free software foundation(?:[,;]? (?:either )?version 2)?"),
    ("agpl-3.0", "url", "agpl", r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("lgpl", "url", "lgpl", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl"),
    ("gpl", "url", "/gpl", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl"),
    ("gfdl", "url", "/fdl", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("agpl-3.0", "grant", "affero agpl", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: \(agpl\))?,?~(?:version |v~|v\.~)?3(?:\.0)?(?![0-9])"),
    ("lgpl-3.0", "grant", "lesser lgpl", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: \(lgpl\))?,?~(?:version |v~|v\.~)?3(?:\.0)?(?![0-9])"),
    ("lgpl-2.1", "grant", "lesser lgpl", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: \(lgpl\))?,?~(?:version |v~|v\.~)?2\.1"),
    ("gpl-3.0", "grant", "general public gpl", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl)(?: \(gpl\))?,?~(?:version |v~|v\.~)?3(?:\.0)?(?![0-9])"),
    ("gpl-2.0", "grant", "general public gpl", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl)(?: \(gpl\))?,?~(?:version |v~|v\.~)?2(?:\.0)?(?![0-9.])"),
    ("agpl", "grant", "affero", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[cs]e"),
    ("lgpl", "grant", "lesser library", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("gpl", "grant", "general public", r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e"),
    ("agpl-3.0", "version", "affero agpl", r"(?:affero general public licen[cs]e,?|agpl)~-?(?:version |v~|v\.~)?3(?:\.0)?(?![0-9])"),
    ("lgpl-3.0", "version", "lesser lgpl", r"(?:lesser general public licen[cs]e,?|lgpl)~-?(?:version |v~|v\.~)?3(?:\.0)?(?![0-9])"),
    ("lgpl-2.1", "version", "lesser lgpl", r"(?:lesser general public licen[cs]e,?|lgpl)~-?(?:version |v~|v\.~)?2\.1"),
    ("gpl-3.0", "version", "general public gpl", r"(?:general public licen[cs]e,?|(?<![a-z])gpl)~-?(?:version |v~|v\.~)?3(?:\.0)?(?![0-9])"),
    ("gpl-2.0", "version", "general public gpl", r"(?:general public licen[cs]e,?|(?<![a-z])gpl)~-?(?:version |v~|v\.~)?2(?:\.0)?(?![0-9.])"),
    ("agpl", "name", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("lgpl", "name", "lesser library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("gpl", "name", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gfdl", "name", "free documentation", r"(?:gnu )?free documentation licen[cs]e"),
    # Weak copyleft
    ("mpl-2.0", "text", "mozilla", r"mozilla public license version 2\.0 ?[=-]* 1\. definitions"),
    ("mpl-1.1", "text", "mozilla", r"mozilla public license version 1\.1 ?[=-]* 1\. definitions"),
    ("mpl-2.0", "header", "mozilla", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0"),
    ("mpl-2.0", "text", "secondary licenses", r"this source code form is [\"“']incompatible with secondary licenses[\"”'],? as defined by the mozilla public license"),
    ("mpl-1.1", "header", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-2.0", "url", "mozilla.org", r"mozilla\.org/(?:mpl/2\.0|en-us/mpl/2\.0)"),
    ("mpl", "url", "mozilla.org", r"mozilla\.org/mpl"),
    ("mpl-2.0", "version", "mozilla mpl", r"(?:mozilla public licen[cs]e,?|(?<![a-z])mpl)~-?(?:version |v~|v\.~)?2(?:\.0)?(?![0-9])"),
    ("mpl", "name", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2.0", "text", "eclipse", r"eclipse public license - v 2\.0 the accompanying program"),
    ("epl-1.0", "text", "eclipse", r"eclipse public license - v 1\.0 the accompanying program"),
    ("epl-2.0", "header", "eclipse", r"made available under the terms of the eclipse public license(?: v\.?~| version )?2\.0"),
    ("epl-1.0", "header", "eclipse", r"made available under the terms of the eclipse public license(?: v\.?~| version )?1\.0"),
    ("epl-2.0", "url", "epl-2.0", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "url", "epl-v10", r"eclipse\.org/legal/epl-v10"),
    ("epl", "name", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl-1.0", "header", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.1", "text", "common development", r"common development and distribution license \(cddl\) version 1\.1"),
    ("cddl-1.0", "text", "common development", r"common development and distribution license \(cddl\) version 1\.0"),
    ("cddl", "name", "common development", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "text", "common public", r"common public license version 1\.0 the accompanying program"),
    ("cpl", "name", "common public", r"common public licen[cs]e"),
    ("eupl-1.2", "text", "european union", r"licensed under the eupl(?:,? version 1\.2)? ?(?:or - as soon they will be approved|only)"),
    ("eupl-1.2", "version", "eupl", r"(?:european union public licen[cs]e,?|eupl)~-?(?:version |v~|v\.~)?1\.2"),
    ("eupl", "name", "european union", r"european union public licen[cs]e"),
    ("osl-3.0", "header", "open software license", r"licensed under the open software license version 3\.0"),
    ("osl", "name", "open software license", r"open software license"),
    ("ms-pl", "name", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", "name", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    # Permissive, others
    ("bsl-1.0", "text", "boost", r"boost software license - version 1\.0 - august 17th,? 2003"),
    ("bsl-1.0", "header", "boost", r"distributed under the boost software license,? version 1\.0"),
    ("bsl-1.0", "url", "license_1_0", r"boost\.org/license_1_0"),
    ("bsl-1.0", "name", "boost", r"boost software licen[cs]e"),
    ("zlib", "text", "misrepresented", r"the origin of this software must not be misrepresented[;,]? you must not claim that you wrote the original software"),
    ("zlib", "text", "as-is", r"this software is provided ['\"]?as-is['\"]?,? without any express or implied warranty\. in no event will the authors be held liable"),
    ("libpng", "text", "png reference library", r"this copy of the libpng notices is provided for your convenience"),
    ("zlib", "name", "zlib", r"(?<![a-z])zlib(?:/libpng)?(?: |-)licen[cs]e"),
    ("unlicense", "text", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "url", "unlicense.org", r"unlicense\.org"),
    ("unlicense", "name", "unlicense", r"(?<![a-z])the unlicense(?![a-z])"),
    ("wtfpl", "text", "do what the", r"do what the f.{2,4} you want to public licen[cs]e"),
    ("wtfpl", "name", "wtfpl", r"(?<![a-z])wtfpl(?![a-z])"),
    ("python-2.0", "text", "python software foundation", r"python software foundation license version 2"),
    ("python-2.0", "name", "psf python", r"(?<![a-z])(?:psf|python(?: software foundation)?) licen[cs]e"),
    ("artistic-2.0", "text", "artistic", r"the artistic license 2\.0 copyright \(c\) 2000-2006,? the perl foundation"),
    ("artistic-1.0", "text", "artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "version", "artistic", r"artistic licen[cs]e,?~(?:version |v~)?2(?:\.0)?"),
    ("artistic", "name", "artistic", r"(?<![a-z])artistic licen[cs]e"),
    ("perl", "grant", "perl", r"under the same terms as perl itself"),
    ("ruby", "grant", "ruby", r"under (?:the )?(?:terms of )?(?:the )?ruby(?:'s)? licen[cs]e"),
    ("php-3.01", "header", "php license", r"this source file is subject to version 3\.01 of the php license"),
    ("php", "name", "php license", r"(?<![a-z])php licen[cs]e"),
    ("openssl", "text", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "name", "openssl", r"openssl licen[cs]e"),
    ("curl", "text", "stenberg", r"copyright \(c\) .{0,80}?daniel stenberg.{0,200}?permission to use,? copy,? modify,? and distribute this software for any purpose"),
    ("unicode", "text", "unicode", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of the unicode data files"),
    ("icu", "text", "icu license", r"icu license - icu 1\.8\.1 and later"),
    ("ofl-1.1", "text", "sil open font", r"sil open font license version 1\.1 - 26 february 2007"),
    ("ofl-1.1", "header", "sil open font", r"this font software is licensed under the sil open font license,? version 1\.1"),
    ("ofl-1.1", "name", "open font", r"(?:sil )?open font licen[cs]e"),
    ("afl-3.0", "header", "academic free", r"licensed under the academic free license version 3\.0"),
    ("afl", "name", "academic free", r"academic free licen[cs]e"),
    ("ncsa", "name", "university of illinois ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e"),
    ("postgresql", "text", "postgresql", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee,? and without a written agreement is hereby granted"),
    ("postgresql", "name", "postgresql", r"postgresql licen[cs]e"),
    ("beerware", "text", "beer", r"(?:the )?beer-?ware licen[cs]e|you can buy me a beer in return"),
    ("json", "text", "not evil", r"the software shall be used for good,? not evil"),
    ("fsf-unlimited", "text", "unlimited permission", r"gives unlimited permission to copy and/or distribute it,? with or without modifications"),
    ("public-domain", "grant", "public domain", r"(?:is|are|placed|released|dedicated)(?: in| into| to)? (?:to )?the public domain"),
    ("proprietary", "text", "confidential unauthori", r"(?:proprietary and confidential|confidential and proprietary)%all rights reserved|unauthori[sz]ed copying of this file,? via any medium,? is strictly prohibited"),
    # Source available
    ("busl-1.1", "text", "business source", r"business source license 1\.1 (?:parameters|license text|terms)"),
    ("busl-1.1", "name", "business source", r"business source licen[cs]e"),
    ("sspl-1.0", "text", "server side public", r"server side public license version 1,? october 16,? 2018"),
    ("sspl", "name", "server side public", r"server side public licen[cs]e"),
    ("elastic-2.0", "name", "elastic license", r"elastic licen[cs]e(?:,? ?(?:version |v)?2\.0)?"),
    ("commons-clause", "text", "commons clause", r"[\"“]?commons clause[\"”]? license condition v1\.0"),
    ("polyform", "name", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e"),
    ("openrail", "name", "rail", r"(?:creativeml )?open ?rail(?:\+\+)?-m(?: licen[cs]e)?"),
    # Creative Commons and data
    ("cc0", "text", "cc0 cc-zero", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "text", "cc0", r"cc0 1\.0 universal(?: statement of purpose)?"),
    ("cc-by-nc-sa", "text", "sharealike", r"attribution-noncommercial-sharealike [1-4]\.[0-9](?: international| unported)?"),
    ("cc-by-nc-nd", "text", "noderiv", r"attribution-noncommercial-noderiv(?:ative)?s [1-4]\.[0-9](?: international| unported)?"),
    ("cc-by-sa", "text", "sharealike", r"(?<!noncommercial-)attribution-sharealike [1-4]\.[0-9](?: international| unported)?"),
    ("cc-by-nd", "text", "noderiv", r"attribution-noderiv(?:ative)?s [1-4]\.[0-9](?: international| unported)?"),
    ("cc-by-nc", "text", "noncommercial", r"attribution-noncommercial [1-4]\.[0-9](?: international| unported)?"),
    ("cc-by", "text", "creative commons attribution", r"creative commons attribution [1-4]\.[0-9](?: international| unported)?(?: public)? licen[cs]e"),
    ("cc-by-nc-sa", "url", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "url", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc", "url", "creativecommons", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-sa", "url", "creativecommons", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "url", "creativecommons", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by", "url", "creativecommons", r"creativecommons\.org/licenses/by/"),
    ("cc0", "url", "creativecommons", r"creativecommons\.org/(?:publicdomain/zero|licenses/cc0)"),
    ("cc-by-nc-sa", "version", "nc-sa", r"(?:cc|creative commons)(?: |-)by-nc-sa"),
    ("cc-by-nc-nd", "version", "nc-nd", r"(?:cc|creative commons)(?: |-)by-nc-nd"),
    ("cc-by-nc", "version", "by-nc", r"(?:cc|creative commons)(?: |-)by-nc(?![a-z-])"),
    ("cc-by-sa", "version", "by-sa", r"(?:cc|creative commons)(?: |-)by-sa"),
    ("cc-by-nd", "version", "by-nd", r"(?:cc|creative commons)(?: |-)by-nd"),
    ("cc-by", "version", "cc commons", r"(?<![a-z])(?:cc|creative commons)(?: |-)(?:by|attribution)(?![a-z-])(?: [1-4]\.[0-9])?"),
    ("cc0", "name", "cc0", r"(?<![a-z0-9])cc0(?![a-z0-9])"),
    ("odbl-1.0", "name", "open database", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by", "name", "open data commons", r"open data commons attribution licen[cs]e"),
    ("cdla", "name", "community data", r"community data licen[cs]e agreement"),
]

#: Identifiers of SPDX tags: one signature, whose label is the identifier that it finds.
SPDX = r"spdx-licen[cs]e-identifier:~\(*(?P<id>[a-z0-9][a-z0-9.+-]*)"
_SUFFIX = re.compile(r"-(?:only|or-later)$|\+$|\.$")


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    kind: str
    pattern: re.Pattern
    order: int = 0

    @property
    def rank(self) -> int:
        return list(KINDS).index(self.kind)

    @property
    def score(self) -> float:
        return KINDS[self.kind]


def expression(plain: str) -> re.Pattern:
    """Blanks, ~ and % of a signature as what they stand for; neither stands in a class of characters."""
    space = r"[\s*#/;>|]"
    return re.compile(plain.replace("%", r".{0,1500}?").replace("~", f"{space}*").replace(" ?", f"{space}*").replace(" ", f"{space}+"), re.DOTALL)


def keywords_of(listed: str, pattern: str) -> tuple[str, ...]:
    """Keywords are listed whole if the expression holds them so, else word by word; those of several words may be broken by a line."""
    whole = listed in pattern
    return (listed.split(" ")[0],) if whole else tuple(listed.split(" "))


def rules() -> list[Rule]:
    """By kind, then as listed."""
    every = [*SIGNATURES, ("", "spdx", "spdx", SPDX)]
    made = [Rule(label, keywords_of(words, p), kind, expression(p), i) for i, (label, kind, words, p) in enumerate(every)]
    return sorted(made, key=lambda r: (r.rank, r.order))


def label_of(rule: Rule, m: re.Match) -> str:
    return rule.label or _SUFFIX.sub("", _SUFFIX.sub("", m["id"]))


def detections(lowered: str, table: list[Rule], gated: bool = True) -> list[tuple[int, int, str, Rule]]:
    """start, end, label, rule of the detections that no stronger one contains."""
    found, seen = [], {}
    for r in table:
        for k in r.keywords:
            if k not in seen:
                seen[k] = k in lowered
        if not gated or any(seen[k] for k in r.keywords):
            found += [(m.start(), m.end(), label_of(r, m), r) for m in r.pattern.finditer(lowered)]
    # Outermost first; what is kept of the rules seen so far is each one's farthest end.
    kept, reach = [], {}
    for a, b, label, r in sorted(found, key=lambda x: (x[0], -x[1], x[3].rank, x[3].order)):
        mine = (r.rank, r.order)
        if not any(end >= b and other < mine for other, end in reach.items()):
            kept.append((a, b, label, r))
        reach[mine] = max(reach.get(mine, 0), b)
    return kept


def scan_text(text: bytes | None, table: list[Rule]) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.translate(WORD_TABLE).split() if text else []
    places, base = [], set()
    if text and b"license" in (low := text.lower()):
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in PHRASES.items():
            at = joined.find(b" " + phrase + b" ")
            if at >= 0:
                base.add(label)
            seen, word = 0, 0
            while at >= 0:
                word += joined.count(b" ", seen, at)
                seen = at
                places.append(word)
                at = joined.find(b" " + phrase + b" ", at + 1)
    labels, score = set(base), 0.5 if base else 0.0
    if text:
        for _, _, label, r in detections(text.lower().decode(), table):
            labels.add(label)
            score = max(score, r.score)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


FIELDS = [
    ("n_words", "bigint", pa.int64()),
    ("n_base", "bigint", pa.int64()),
    ("first_word", "bigint", pa.int64()),
    ("last_word", "bigint", pa.int64()),
    ("base_labels", "string", pa.string()),
    ("labels", "string", pa.string()),
    ("score", "double", pa.float64()),
]


def scan(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns `keep`, then those of FIELDS."""

    def make():
        table = rules()
        return lambda texts: [list(c) for c in zip(*(scan_text(t, table) for t in texts), strict=True)]

    return map_texts(docs, keep, FIELDS, make, text)


def scan_documents(docs: DataFrame) -> DataFrame:
    return scan(docs, {"doc_id": F.col("doc_id")})
