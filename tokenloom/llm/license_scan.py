"""License scans by ordered signature rules, in DataFrame operations only.

A rule is a regular expression over the normalised text (lower-case words parted by one space), a keyword without which it
cannot match (a whole word, or with a star the start of one), a priority and a confidence. A few words that every rule needs one of gate whole texts; a text that passes them
tries the rules whose keyword it has. Overlaps are resolved on intervals: sorted by start and longest first, a detection that
lies inside one of the same or a better priority is suppressed.

The rules are hand-written names (NAMES, CREATIVE_COMMONS) set into hand-written phrases (PHRASES), single notices (NOTICES), and clauses that licence texts and notices are known by (CLAUSES).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from .common import NOT_WORD, ascii_lower, let, others, text_of

#: Fixed values of the contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, keyword, expression of the name, SPDX identifier as normalised words.
NAMES = (
    ("apache-1.0", "apache", r"apache(?: software)? license(?: version)? (?:v ?)?1 0", "apache 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? (?:v ?)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? license(?: version)? (?:v ?)?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", r"apache(?: software)? license", "apache"),
    ("mit", "mit", r"mit(?: style| expat)? licen[cs]e", "mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("bsd-0-clause", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?", "0bsd"),
    ("bsd-1-clause", "bsd", r"(?:one|1) clause bsd(?: licen[cs]e)?", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:(?:two|2) clause|simplified|freebsd) bsd(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:three|3) clause|new|revised|modified) bsd(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:four|4) clause|original|old) bsd(?: licen[cs]e)?", "bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", "bsd"),
    ("gpl-1", "public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?1(?: 0)?", "gpl 1 0"),
    ("gpl-2", "public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", "public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?3(?: 0)?", "gpl 3 0"),
    ("gpl-2", "gpl*", r"(?:gnu )?gpl ?(?:version )?(?:v ?)?2(?: 0)?", "gpl v2"),
    ("gpl-3", "gpl*", r"(?:gnu )?gpl ?(?:version )?(?:v ?)?3(?: 0)?", "gpl v3"),
    ("gpl", "public", r"(?:gnu )?general public license", "gpl"),
    ("lgpl-2", "public", r"(?:gnu )?library general public license(?: version)?(?: (?:v ?)?2(?: 0)?)?", "lgpl 2 0"),
    ("lgpl-2.1", "public", r"(?:gnu )?lesser general public license(?: version)? (?:v ?)?2 1", "lgpl 2 1"),
    ("lgpl-3", "public", r"(?:gnu )?lesser general public license(?: version)? (?:v ?)?3(?: 0)?", "lgpl 3 0"),
    ("lgpl", "public", r"(?:gnu )?lesser general public license", "lgpl"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?: version)? (?:v ?)?3(?: 0)?", "agpl 3 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public license", "agpl"),
    ("gfdl-1.2", "documentation", r"(?:gnu )?free documentation license(?: version)? (?:v ?)?1 2", "gfdl 1 2"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation license(?: version)? (?:v ?)?1 3", "gfdl 1 3"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license", "gfdl"),
    ("mpl-1.0", "mozilla", r"mozilla public license(?: version)? (?:v ?)?1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? (?:v ?)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)? (?:v ?)?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public license", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? (?:v ?)?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)? (?:v ?)?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", r"eclipse public license", "epl"),
    ("cddl-1.0", "common", r"common development and distribution license(?: version)?(?: (?:v ?)?1 0)?", "cddl 1 0"),
    ("cddl-1.1", "common", r"common development and distribution license(?: version)? (?:v ?)?1 1", "cddl 1 1"),
    ("cpl-1.0", "common", r"common public license(?: version)?(?: (?:v ?)?1(?: 0)?)?", "cpl 1 0"),
    ("eupl-1.1", "european", r"european union public licen[cs]e(?: version)? (?:v ?)?1 1", "eupl 1 1"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version)? (?:v ?)?1 2", "eupl 1 2"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("bsl-1.0", "boost", r"boost software license(?: version)?(?: (?:v ?)?1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business", r"business source license(?: version)?(?: (?:v ?)?1 1)?", "busl 1 1"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? (?:v ?)?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? (?:v ?)?2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", r"artistic license", "artistic"),
    ("python-2.0", "python", r"python software foundation license(?: version)?(?: (?:v ?)?2(?: 0)?)?", "python 2 0"),
    ("php-3.0", "php", r"php license(?: version)?(?: (?:v ?)?3 0)?", "php 3 0"),
    ("php-3.01", "php", r"php license(?: version)? (?:v ?)?3 01", "php 3 01"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: version)?(?: (?:v ?)?1 1)?", "ofl 1 1"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl"),
    ("afl-3.0", "academic", r"academic free license(?: version)?(?: (?:v ?)?3(?: 0)?)?", "afl 3 0"),
    ("osl-3.0", "open", r"open software license(?: version)?(?: (?:v ?)?3(?: 0)?)?", "osl 3 0"),
    ("apsl-2.0", "apple", r"apple public source license(?: version)?(?: (?:v ?)?2(?: 0)?)?", "apsl 2 0"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source license", "ncsa"),
    ("openssl", "openssl", r"openssl license", "openssl"),
    ("odbl-1.0", "database", r"open(?: data commons open)? database license(?: version)?(?: (?:v ?)?1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", r"open data commons attribution license(?: version)?(?: (?:v ?)?1 0)?", "odc by 1 0"),
    ("pddl-1.0", "domain", r"public domain dedication and license(?: version)?(?: (?:v ?)?1 0)?", "pddl 1 0"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("vim", "vim", r"vim licen[cs]e", "vim"),
    ("curl", "curl", r"curl licen[cs]e", "curl"),
    ("x11", "x11", r"x11 licen[cs]e", "x11"),
)
#: Suffix of the label, words of the short form, words of the long form; every one with each version.
CREATIVE_COMMONS = (
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0", "")
#: Priority, confidence, expression with the name or the identifier set in. Lower priorities are better.
PHRASES = (
    (0, 1.0, "spdx license identifier {id}(?: or later| only)?"),
    (1, 0.95, "(?:licen[cs]ed|re ?licen[cs]ed|released|distributed|redistributed|available|published|provided|covered|made available) (?:by|to you under|under)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {name}"),
    (2, 0.8, "{name}"),
)
#: label, keyword, priority, confidence, expression.
NOTICES = (
    ("cc0", "cc0", 1, 0.95, r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "zero", 1, 0.9, r"creative commons zero(?: licen[cs]e)?"),
    ("public-domain", "public", 2, 0.8, r"(?:dedicated|released|placed|is) (?:to|into|in) the public domain"),
    ("public-domain", "public", 3, 0.5, r"public domain"),
    ("mit", "permission", 1, 0.9, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 1, 0.9, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", 1, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "program", 1, 0.9, r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", "library", 1, 0.9, r"this library is free software you can redistribute it and or modify it"),
    ("zlib", "implied", 1, 0.9, r"this software is provided as is without any express or implied warranty"),
    ("warranty-disclaimer", "warranty", 2, 0.5, r"without (?:any )?warranty(?: of any kind)?"),
    ("warranty-disclaimer", "warranties", 2, 0.5, r"without warranties or conditions of any kind"),
    ("unlicense", "unencumbered", 1, 0.9, r"this is free and unencumbered software released into the public domain"),
    ("reserved", "reserved", 2, 0.7, r"(?:all|some|no) rights reserved"),
    ("copyright", "copyright", 3, 0.4, r"copyright(?: c)?(?: [0-9]{4})+"),
    ("copyright", "copyright", 3, 0.3, r"copyright (?:notice|holders?|owners?)"),
    ("proprietary", "proprietary", 2, 0.7, r"(?:proprietary and confidential|confidential and proprietary|proprietary licen[cs]e|proprietary software)"),
    ("proprietary", "commercial", 2, 0.7, r"commercial licen[cs]e(?: agreement)?"),
    ("eula", "end", 2, 0.7, r"end user licen[cs]e agreement"),
    ("noncommercial", "non*", 3, 0.5, r"for non ?commercial (?:use|purposes) only"),
    ("noncommercial", "noncommercial", 3, 0.5, r"for noncommercial (?:use|purposes) only"),
    ("trademark", "trademark*", 3, 0.3, r"(?:registered )?trademarks? of"),
)
#: Clauses of licence texts and notices, in the form of NOTICES.
CLAUSES = (
    ("mit", "sublicense", 1, 0.85, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission", 1, 0.85, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", 2, 0.6, r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "claim", 2, 0.7, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "hereby", 2, 0.6, r"hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction"),
    ("x11", "consortium", 1, 0.85, r"except as contained in this notice the name of (?:the )?x consortium shall not be used in advertising"),
    ("isc", "appear", 1, 0.85, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "author", 1, 0.8, r"the author disclaims all warranties with regard to this software"),
    ("isc", "tortious", 1, 0.75, r"an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistributions", 1, 0.85, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 1, 0.85, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", 1, 0.9, r"neither the name of (?:[a-z0-9]+ ){0,12}[a-z0-9]+ nor the names of (?:its|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", 1, 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "provided", 1, 0.8, r"this software is provided by the (?:copyright holders and contributors|regents and contributors|author and contributors) as is"),
    ("bsd", "exemplary", 1, 0.75, r"direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "regents", 1, 0.8, r"the regents of the university of california"),
    ("apache-2.0", "compliance", 1, 0.9, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "obtain", 1, 0.8, r"you may obtain a copy of the license at"),
    ("apache-2.0", "limitations", 1, 0.9, r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "agreed", 1, 0.9, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "contributor", 1, 0.85, r"each contributor hereby grants to you a perpetual worldwide non ?exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-2.0", "notice", 1, 0.75, r"if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", "prominent", 2, 0.7, r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-1.1", "apache", 1, 0.85, r"this product includes software developed by the apache software foundation"),
    ("apache", "foundation", 2, 0.7, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "redistribute", 1, 0.85, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "hope", 1, 0.8, r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "merchantability", 2, 0.7, r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received", 1, 0.85, r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2", "franklin", 1, 0.85, r"free software foundation inc 51 franklin (?:st|street) fifth floor boston ma"),
    ("gpl-2", "temple", 1, 0.85, r"free software foundation inc 59 temple place suite 330 boston ma"),
    ("gpl-2", "mass", 1, 0.8, r"free software foundation inc 675 mass ave cambridge ma"),
    ("gpl-3", "later", 1, 0.85, r"either version 3 of the license or at your option any later version"),
    ("gpl-2", "later", 1, 0.85, r"either version 2 of the license or at your option any later version"),
    ("lgpl-2.1", "later", 1, 0.85, r"either version 2 1 of the license or at your option any later version"),
    ("gpl-1", "later", 1, 0.8, r"either version 1 or at your option any later version"),
    ("gpl-3", "propagate", 1, 0.8, r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("gpl-3", "installation", 1, 0.75, r"installation information for a user product means any methods procedures authorization keys"),
    ("gpl-2", "verbatim", 1, 0.75, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-classpath", "linking", 1, 0.85, r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-classpath", "exception", 1, 0.85, r"classpath exception to the (?:gnu )?gpl"),
    ("gpl-font", "font", 1, 0.8, r"if you create a document which uses this font and embed this font"),
    ("gcc-exception", "gcc", 1, 0.85, r"gcc runtime library exception"),
    ("lgpl", "incorporates", 1, 0.85, r"the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl", "lesser", 1, 0.85, r"you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("agpl-3", "remotely", 1, 0.8, r"interacting with it remotely through a computer network"),
    ("agpl-3", "affero", 1, 0.85, r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "invariant", 1, 0.85, r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla", 1, 0.9, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", 1, 0.85, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", 1, 0.9, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "incompatible", 1, 0.85, r"incompatible with secondary licenses"),
    ("mpl-1.1", "original", 2, 0.7, r"the initial developer of the original code is"),
    ("epl", "eclipse", 1, 0.85, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "recipient", 1, 0.75, r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cpl-1.0", "common", 1, 0.85, r"the accompanying program is provided under the terms of this common public license"),
    ("cddl-1.0", "development", 1, 0.85, r"subject to the terms of the common development and distribution license the license"),
    ("cddl-1.0", "header", 1, 0.75, r"when distributing covered code include this cddl header notice in each file"),
    ("artistic", "intent", 1, 0.75, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "holder", 1, 0.75, r"such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2.0", "standard", 1, 0.75, r"distribute verbatim copies of the source form of the standard version of this package"),
    ("perl", "perl", 1, 0.85, r"(?:you can|you may) redistribute it and or modify it under the same terms as perl itself"),
    ("perl", "perl", 2, 0.7, r"same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)? itself"),
    ("zlib", "misrepresented", 1, 0.85, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 1, 0.8, r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "organization", 1, 0.85, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsl-1.0", "executable", 1, 0.8, r"solely in the form of machine executable object code generated by a source language processor"),
    ("ofl-1.1", "reserved", 1, 0.75, r"no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", "font", 1, 0.85, r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "bundled", 1, 0.75, r"the fonts?(?: including any derivative works)? can be bundled embedded redistributed and or sold"),
    ("unlicense", "anyone", 1, 0.85, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "perpetuity", 1, 0.75, r"overt act of relinquishment in perpetuity of all present and future rights to this software"),
    ("cc0", "waived", 1, 0.75, r"to the extent possible under law (?:[a-z0-9]+ ){0,8}[a-z0-9]+ has waived all copyright and related or neighboring rights"),
    ("cc0", "affirmer", 1, 0.8, r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("wtfpl", "do", 1, 0.85, r"do what the fuck you want to public license"),
    ("beerware", "beer", 1, 0.85, r"buy me a beer in return"),
    ("beerware", "beerware", 1, 0.8, r"(?:the )?beerware license"),
    ("json", "good", 1, 0.8, r"the software shall be used for good not evil"),
    ("python-2.0", "psf", 1, 0.85, r"psf is making python available to licensee on an as is basis"),
    ("python-2.0", "python", 1, 0.75, r"python software foundation all rights reserved"),
    ("php-3.01", "php", 1, 0.85, r"this product includes php software freely available from"),
    ("openssl", "openssl", 1, 0.85, r"this product includes software developed by the openssl project"),
    ("openssl", "cryptographic", 1, 0.85, r"this product includes cryptographic software written by eric young"),
    ("ssleay", "ssleay", 1, 0.75, r"(?:original )?ssleay license"),
    ("curl", "curl", 2, 0.7, r"copyright notice and this permission notice appear in all copies of curl"),
    ("sspl-1.0", "server", 1, 0.85, r"server side public license(?: version)?(?: (?:v ?)?1)?"),
    ("sspl-1.0", "service", 1, 0.8, r"offering the program as a service you must make the service source code available"),
    ("elastic-2.0", "elastic", 1, 0.85, r"elastic license(?: version)?(?: (?:v ?)?2(?: 0)?)?"),
    ("elastic-2.0", "hosted", 1, 0.75, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons", 1, 0.85, r"commons clause license condition"),
    ("commons-clause", "sell", 1, 0.75, r"the license does not include and the license does not grant to you the right to sell the software"),
    ("busl-1.1", "production", 1, 0.8, r"the licensor may make an additional use grant above permitting limited production use"),
    ("busl-1.1", "change", 1, 0.75, r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("polyform", "polyform", 1, 0.85, r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) license"),
    ("openrail", "open*", 1, 0.85, r"(?:creativeml )?open ?rail(?: [ms])?(?: license)?"),
    ("llama", "llama", 1, 0.85, r"llama (?:2|3|3 1|3 2) community license(?: agreement)?"),
    ("gemma", "gemma", 1, 0.8, r"gemma (?:terms of use|prohibited use policy)"),
    ("ms-pl", "contributor", 2, 0.7, r"each contributor grants you a non ?exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("ms-rl", "reciprocal", 1, 0.8, r"reciprocal grants for any file you distribute that contains code from the software"),
    ("ecl-2.0", "educational", 1, 0.85, r"educational community license(?: version)?(?: (?:v ?)?2(?: 0)?)?"),
    ("cecill", "cecill", 1, 0.85, r"cecill(?: [abc])?(?: free software)?(?: license)?(?: agreement)?"),
    ("mulan", "mulan", 1, 0.85, r"mulan (?:psl|permissive software license)(?: v2)?"),
    ("nasa-1.3", "nasa", 1, 0.85, r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("ipl-1.0", "ibm", 1, 0.85, r"ibm public license(?: version)?(?: (?:v ?)?1(?: 0)?)?"),
    ("sun-sissl", "sun", 1, 0.8, r"sun industry standards source license"),
    ("qpl-1.0", "q", 1, 0.8, r"q public license(?: version)?(?: (?:v ?)?1(?: 0)?)?"),
    ("lppl", "latex", 1, 0.85, r"latex project public license(?: version)?(?: 1 3c?)?"),
    ("upl-1.0", "universal", 1, 0.85, r"universal permissive license(?: version)?(?: (?:v ?)?1(?: 0)?)?"),
    ("blueoak-1.0", "oak", 1, 0.85, r"blue oak model license(?: version)?(?: (?:v ?)?1(?: 0)?(?: 0)?)?"),
    ("etalab-2.0", "ouverte", 1, 0.8, r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?"),
    ("ogl-3.0", "government", 1, 0.85, r"open government licen[cs]e(?: version)?(?: (?:v ?)?[123](?: 0)?)?"),
    ("us-government", "government", 2, 0.6, r"(?:this )?work of the (?:united states|u s) government"),
    ("fal-1.3", "art", 1, 0.8, r"(?:free art|art libre) licen[cs]e(?: 1 3)?"),
    ("hippocratic", "hippocratic", 1, 0.85, r"hippocratic licen[cs]e(?: [123](?: [01])?)?"),
    ("cc-by-sa", "gfdl", 1, 0.8, r"dual licensed under (?:the )?gfdl and (?:the )?creative commons attribution share ?alike"),
    ("cc-by", "appropriate", 2, 0.6, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "remix", 2, 0.6, r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "commercial", 2, 0.6, r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", 2, 0.6, r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc", "readable", 2, 0.6, r"this is a human readable summary of and not a substitute for the license"),
    ("stackexchange", "contributions", 2, 0.6, r"user contributions licensed under cc by sa"),
    ("wikipedia", "text", 2, 0.7, r"text is available under the creative commons attribution share ?alike license"),
    ("proprietary", "confidential", 2, 0.7, r"this (?:document|software|file|material) (?:contains|is|includes) confidential(?: and proprietary)? information"),
    ("proprietary", "trade", 2, 0.6, r"unpublished trade secret"),
    ("proprietary", "reproduced", 2, 0.6, r"no part of this (?:publication|book|document|work|site|website) may be reproduced"),
    ("proprietary", "prohibited", 2, 0.6, r"(?:unauthorized|unauthorised) (?:reproduction|copying|use|duplication)(?: or distribution)?(?: of this (?:file|material|software|content|work))?(?: via any medium)? is strictly prohibited"),
    ("proprietary", "written", 2, 0.5, r"without (?:the )?(?:prior |express |prior express )?written (?:permission|consent) of"),
    ("proprietary", "transmitted", 2, 0.5, r"stored in a retrieval system or transmitted in any form or by any means"),
    ("eula", "bound", 2, 0.7, r"by (?:installing|downloading)(?: copying)? or (?:otherwise )?using (?:the|this) software (?:product )?you agree to be bound"),
    ("eula", "reverse", 2, 0.6, r"you may not reverse engineer decompile or disassemble"),
    ("eula", "licensed", 2, 0.6, r"the software is licensed not sold"),
    ("terms", "terms", 3, 0.4, r"(?:use of this (?:site|website)|your use) (?:is subject to|constitutes acceptance of)(?: our| the)? terms (?:of (?:use|service)|and conditions)"),
    ("royalty-free", "royalty", 3, 0.4, r"royalty free licen[cs]e"),
    ("dual-license", "dual", 2, 0.6, r"dual licensed under"),
    ("dual-license", "option", 2, 0.5, r"at your option under(?: either)?(?: the terms of)?"),
    ("trademark", "respective", 3, 0.3, r"(?:are|is) (?:the )?(?:property|trademarks?|registered trademarks?) of (?:its|their) respective owners?"),
    ("warranty-disclaimer", "provided", 2, 0.5, r"provided as is (?:and )?without (?:any )?(?:express or implied )?warrant(?:y|ies)"),
    ("warranty-disclaimer", "kind", 2, 0.5, r"without warranty of any kind (?:either )?express(?:ed)? or implied"),
    ("liability-disclaimer", "liable", 3, 0.4, r"(?:in no event|under no circumstances) shall (?:[a-z0-9]+ ){0,8}[a-z0-9]+ be (?:held )?liable for any"),
    ("no-license", "granted", 3, 0.4, r"no licen[cs]e is granted"),
    ("attribution", "attribution", 3, 0.4, r"attribution (?:is )?required"),
    ("noncommercial", "personal", 2, 0.5, r"for personal(?: and)? non ?commercial use"),
    ("noncommercial", "only", 2, 0.5, r"for (?:educational|academic|research)(?: and research)? (?:use|purposes) only"),
)
#: A text without any of these has no detection: every rule's expression holds one of them.
GATES = ("licen", "spdx", " cc", "creative commons", "public domain", "permission ", "redistribution ", "free software", "provided as is", "warrant", "unencumbered", "rights reserved", "copyright", "proprietary", "commercial", "trademark", "gpl", "bsd", "wtfpl", "mit no attribution", "software", "redistribut", " gnu ", "liable", "exemplary", "regents", " noninfringement ", " tortious ", "contributor", "prominent notices", "notice text file", "plainly marked", "propagate", "installation information", "verbatim", "linking", "classpath", "this font", " gcc ", "remotely", "invariant", "mozilla", " mpl ", "secondary licenses", "original code", "recipient", "cddl", "a package may", "semblance of artistic", " perl ", "object code", "font name", " fonts ", "font can be", "relinquishment", "waive", "buy me a beer", "beerware", " psf ", "ssleay", "openssl", "as a service", "managed service", " sell ", "grant", " rail", " openrail", "gemma ", "code from the", "cecill", "mulan", "nasa open", "ouverte", "government", " art ", "gfdl", "appropriate credit", "remix", "confidential", "trade secret", "reproduced", "prohibited", "written permission", "written consent", "retrieval system", "reverse engineer", " terms ", "at your option", "respective owner", "personal", "purposes only", "use only", "attribution required", "attribution is required", "do what the", "free software foundation", "advertising", "change date", "unless required by")
MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
LEVELS = 4
#: Items of a run that a sweep gathers: appending costs time in the length of what is appended to.
PIECE = 256


@cache
def rules() -> list[tuple[str, str, int, float, str]]:
    """label, keyword, priority, confidence, expression of all rules in order."""
    names = list(NAMES)
    for suffix, short, long in CREATIVE_COMMONS:
        for version in CC_VERSIONS:
            label = f"cc-{suffix}" + (f"-{version.replace(' ', '.')}" if version else "")
            tail = f" {version}" if version else ""
            names.append((label, "cc", f"cc {short}{tail}", f"cc {short}{tail}"))
            names.append((label, "commons", f"creative commons {long}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?(?: version)?{tail}", ""))
    out = []
    for priority, confidence, phrase in PHRASES:
        for label, keyword, name, spdx in names:
            if "{id}" not in phrase:
                out.append((label, keyword, priority, confidence, phrase.format(name=name)))
            elif spdx:
                out.append((label, "spdx", priority, confidence, phrase.format(id=spdx)))
    out += NOTICES + CLAUSES
    return [(label, f" {keyword[:-1]}" if keyword.endswith("*") else f" {keyword} ", priority, confidence, f"(?<= )(?:{expression})(?= )") for label, keyword, priority, confidence, expression in out]


def normalised(text: Column) -> Column:
    """Words parted by one space, with a space before and after; one space if there is no word."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), "(?:" + NOT_WORD + ")", " ")


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


_MATCH = "array<struct<start:int,end:int>>"
_FOUND = "array<struct<rule:int,label:string,start:int,end:int,priority:int,confidence:double>>"


def pieces_of(items: Column) -> Column:
    """Items cut into runs of PIECE. Sweeps start anew in each with what the runs before it add up to, so very many items cost about linear time."""
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / PIECE).cast("int") - 1, F.lit(0))), lambda k: F.slice(x, k * PIECE + 1, PIECE))
    return let(items, runs)


def matches(text: Column, rule: Column) -> Column:
    """Intervals of a rule's matches in text, as start and end characters from 0."""
    def put(acc, pair):
        start = acc["at"] + pair["gap"]
        end = start + pair["hit"]
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("found"))

    none = F.array().cast(_MATCH)
    hits = F.regexp_extract_all(text, rule, F.lit(0))
    each = lambda h: F.zip_with(h, F.slice(F.split(text, rule, -1), 1, F.size(h)), lambda hit, gap: F.struct(F.length(hit).alias("hit"), F.length(gap).alias("gap")))
    length = lambda run: F.aggregate(run, F.lit(0), lambda n, pair: n + pair["gap"] + pair["hit"])
    upto = lambda lengths, k: F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda n, x: n + x)
    swept = lambda runs, lengths: F.flatten(F.transform(runs, lambda run, k: F.aggregate(run, F.struct(upto(lengths, k).alias("at"), none.alias("found")), put, lambda acc: acc["found"])))
    of = lambda runs: let(F.transform(runs, length), lambda lengths: swept(runs, lengths))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(pieces_of(each(h)), of)).otherwise(none))


def detected(text: Column) -> Column:
    """All detections in text in order: start, longest first, best priority, first rule."""
    by_keyword: dict[str, list[str]] = {}
    text_of_sql = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for n, (label, keyword, priority, confidence, expression) in enumerate(rules()):
        rule = f"named_struct('rule', {n}, 'label', {text_of_sql(label)}, 'priority', {priority}, 'confidence', {confidence}D, 'expression', {text_of_sql(expression)})"
        by_keyword.setdefault(keyword, []).append(rule)
    # one literal, parsed at once: hundreds of columns made one by one would take the driver seconds
    table = F.expr("array(" + ", ".join(f"named_struct('keyword', {text_of_sql(k)}, 'rules', array({', '.join(own)}))" for k, own in by_keyword.items()) + ")")
    tried = F.flatten(F.transform(F.filter(table, lambda k: F.contains(text, k["keyword"])), lambda k: k["rules"]))
    found = F.flatten(F.transform(tried, lambda r: F.transform(matches(text, r["expression"]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    return F.array_sort(found)


def resolved(found: Column) -> Column:
    """Without the detections that lie inside one of the same or a better priority."""
    nowhere = F.array(*[F.lit(-1)] * LEVELS)
    reach = lambda ends, d: F.transform(ends, lambda e, level: F.when(level >= d["priority"], F.greatest(e, -d["minus_end"])).otherwise(e))

    def sweep(acc, d):
        end = -d["minus_end"]
        inside = F.element_at(acc["ends"], d["priority"] + 1) >= end
        kept = F.struct(d["rule"].alias("rule"), d["label"].alias("label"), d["start"].alias("start"), end.alias("end"), d["priority"].alias("priority"), d["confidence"].alias("confidence"))
        return F.struct(reach(acc["ends"], d).alias("ends"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(kept))).alias("kept"))

    none = F.array().cast(_FOUND)
    before = lambda ends, k: F.aggregate(F.slice(ends, 1, k), nowhere, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    swept = lambda runs, ends: F.flatten(F.transform(runs, lambda run, k: F.aggregate(run, F.struct(before(ends, k).alias("ends"), none.alias("kept")), sweep, lambda acc: acc["kept"])))
    return let(pieces_of(found), lambda runs: let(F.transform(runs, lambda run: F.aggregate(run, nowhere, reach)), lambda ends: swept(runs, ends)))


def license_scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Null and empty texts have no words and no detections: counts 0, places null, labels empty, score 0. The score is the best
    confidence of the detections that stay, 0.5 if only a base phrase is there. Labels are distinct, sorted, comma-joined;
    those of the base phrases are always among them. Each row stands alone: repeated rows and identifiers don't matter, nothing
    is shuffled. A text of any length is scanned whole, once for each rule whose keyword it has. Input columns named as a made column are replaced; all others are carried along.
    """
    phrases = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
    none = F.array().cast(_FOUND)

    def scan(t: Column) -> Column:
        n = F.greatest(spaces(t) - 1, F.lit(0))
        gate = F.lit(False)
        for g in GATES:
            gate = gate | F.contains(t, F.lit(g))
        base = F.lit(False)
        for p, _ in BASE:
            base = base | F.contains(t, F.lit(f" {p} "))
        hits, parts = F.regexp_extract_all(t, F.lit(phrases), F.lit(0)), F.split(t, phrases, -1)
        first = spaces(F.element_at(parts, 1)) - 1
        last = n - (spaces(F.element_at(parts, -1)) - 1) - (spaces(F.element_at(hits, -1)) + 1)
        labels = F.array_sort(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE])))
        return F.struct(
            n.alias("n_words"), F.when(base, F.size(hits)).otherwise(0).cast("long").alias("n_base"), F.when(base, first).alias("first_word"), F.when(base, last).alias("last_word"),
            F.when(base, labels).otherwise(F.array().cast("array<string>")).alias("base"), F.when(gate, resolved(detected(t))).otherwise(none).alias("detections"),
        )

    out = df.withColumn("__scan", let(normalised(text_of(text_col)), scan))
    s = F.col("__scan")
    labels = F.array_sort(F.array_union(s["base"], F.transform(s["detections"], lambda d: d["label"])))
    best = F.coalesce(F.array_max(F.transform(s["detections"], lambda d: d["confidence"])), F.lit(0.0))
    made = {
        "n_words": s["n_words"], "n_base": s["n_base"], "first_word": s["first_word"], "last_word": s["last_word"], "base_labels": F.array_join(s["base"], ","), "labels": F.array_join(labels, ","),
        "score": F.greatest(best, F.when(s["n_base"] > 0, 0.5).otherwise(0.0)), "detections": s["detections"],
    }
    return out.select(*others(df, *MADE), *[made[c].alias(c) for c in MADE])


def op6_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs.select("doc_id", "text")).select("doc_id", *[c for c in MADE if c != "detections"], F.size("detections").alias("n_detections"))
