"""Signature rules for licence texts, over normalized text.

Normalized text has lower-case words of letters and digits with single spaces,
so `Apache-2.0` reads `apache 2 0`. Each licence gives one rule for each form
in which it is stated; rules for general statements and for the sentences of
licence texts and notices are written out. The keywords that let a rule be
skipped are derived from its pattern, so a match is never skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from re import _parser


@dataclass(frozen=True)
class Rule:
    """A labelled pattern. A higher priority wins."""

    label: str
    priority: int
    pattern: str

    @cached_property
    def keywords(self) -> tuple[str, ...]:
        """Whole words of which every match has at least one."""
        chosen = set()
        for text in sorted(wordings(self.pattern), key=len):
            words = [w for w in text.split(" ") if w and ANY not in w]
            if not chosen.intersection(words):
                chosen.add(max(words, key=_telling))
        return tuple(sorted(chosen))


#: Stands for characters that a pattern leaves open.
ANY = "*"
#: Words that many texts have are the last to be keywords.
COMMON = frozenset("a all and any are as at be by can copy distribute file for free from in is it its may modify more no not of on or own public see software that the this to under use used you your with work license licence licenses licensed released distributed available published provided covered identifier terms conditions version agreement new received permission original international".split())


def _telling(word: str) -> tuple[bool, int, str]:
    return word not in COMMON, sum(map(str.isalpha, word)), word


def wordings(pattern: str) -> set[str]:
    """What a pattern matches, with ANY for open characters and what may be repeated taken once or left out.

    A match has all words of one of these, and maybe more.
    """

    def walk(items) -> set[str]:
        made = {""}
        for op, value in items:
            op = str(op)
            if op == "LITERAL":
                ways = {chr(value)}
            elif op == "SUBPATTERN":
                ways = walk(value[3])
            elif op == "BRANCH":
                ways = set().union(*(walk(way) for way in value[1]))
            elif op == "IN" and all(str(kind) == "LITERAL" for kind, _ in value):
                ways = {chr(c) for _, c in value}
            elif op.endswith("_REPEAT"):
                ways = walk(value[2]) if value[0] else {"", *walk(value[2])}
            else:
                ways = {ANY}
            made = {a + b for a in made for b in ways}
        return made

    return walk(_parser.parse(pattern))


#: label, identifier, name, address
LICENSES = [
    ("mit", "mit", "(?:mit|expat)(?: x11)? licen[sc]e", "opensource org licenses? mit"),
    ("mit-0", "mit 0", "mit no attribution(?: licen[sc]e)?", "opensource org licenses? mit 0"),
    ("apache-1.1", "apache 1 1", "apache(?: software)? licen[sc]e(?: version)? 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache 2 0", "apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?", "apache org licenses license 2 0"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: version)? v?1(?: 0)?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: version)? v?2(?: 0)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: version)? v?3(?: 0)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", "(?:gnu )?(?:library general public licen[sc]e|lgpl)(?: version)? v?2(?: 0)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version)? v?2 1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version)? v?3(?: 0)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", "(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version)? v?3(?: 0)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "gnu free documentation licen[sc]e(?: version)? 1 3", "gnu org licenses fdl 1 3"),
    ("bsd-2-clause", "bsd 2 clause", "(?:simplified bsd|freebsd|bsd (?:2|two) clause)(?: licen[sc]e)?", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", "(?:new bsd|revised bsd|modified bsd|bsd (?:3|three) clause)(?: licen[sc]e)?", "opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", "(?:original bsd|bsd (?:4|four) clause)(?: licen[sc]e)?", "directory fsf org wiki license bsd 4 ?clause"),
    ("0bsd", "0bsd", "(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[sc]e)?", "opensource org licenses? 0bsd"),
    ("isc", "isc", "isc licen[sc]e", "opensource org licenses? isc"),
    ("mpl-1.1", "mpl 1 1", "(?:mozilla public licen[sc]e|mpl)(?: version)? v?1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mpl 2 0", "(?:mozilla public licen[sc]e|mpl)(?: version)? v?2(?: 0)?", "mozilla org mpl 2 0"),
    ("epl-1.0", "epl 1 0", "(?:eclipse public licen[sc]e|epl)(?: version)? v?1(?: 0)?", "eclipse org legal epl v10"),
    ("epl-2.0", "epl 2 0", "(?:eclipse public licen[sc]e|epl)(?: version)? v?2(?: 0)?", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "cddl 1 0", "(?:common development and distribution licen[sc]e|cddl)(?: version)?(?: v?1(?: 0)?)?", "opensource org licenses? cddl 1 0"),
    ("cpl-1.0", "cpl 1 0", "common public licen[sc]e(?: version)?(?: 1 0)?", "opensource org licenses? cpl 1 0"),
    ("artistic-1.0", "artistic 1 0", "artistic licen[sc]e(?: version)? 1 0", "opensource org licenses? artistic 1 0"),
    ("artistic-2.0", "artistic 2 0", "artistic licen[sc]e(?: version)? 2 0", "opensource org licenses? artistic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "opensource org licenses? zlib"),
    ("bsl-1.0", "bsl 1 0", "boost software licen[sc]e(?: version)?(?: 1 0)?", "boost org license 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicen[sc]e", "unlicense org"),
    ("wtfpl", "wtfpl", "(?:wtfpl|do what the \\S+ you want to public licen[sc]e)", "wtfpl net"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "opensource org licenses? postgresql"),
    ("python-2.0", "(?:python|psf) 2 0", "(?:python software foundation|psf|python) licen[sc]e(?: version)?(?: 2)?", "docs python org 3 license"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby lang org en about license"),
    ("php-3.01", "php 3 01", "php licen[sc]e(?: version)?(?: 3 01)?", "php net license"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?", "scripts sil org ofl"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl org source license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "opensource org licenses? ncsa"),
    ("ms-pl", "ms pl", "microsoft public licen[sc]e", "opensource org licenses? ms pl"),
    ("eupl-1.2", "eupl 1 2", "(?:european union public licen[sc]e|eupl)(?: version)? v?1 2", "joinup ec europa eu collection eupl"),
    ("upl-1.0", "upl 1 0", "universal permissive licen[sc]e(?: version)?(?: 1 0)?", "oss oracle com licenses upl"),
    ("cc0-1.0", "cc0 1 0", "(?:cc0|creative commons zero)(?: licen[sc]e)?(?: 1 0)?", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-3.0", "cc by 3 0", "(?:creative commons attribution|cc by) 3 0(?: licen[sc]e)?", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "cc by 4 0", "(?:creative commons attribution|cc by) 4 0(?: licen[sc]e)?", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "(?:creative commons attribution share ?alike|cc by sa) 4 0(?: licen[sc]e)?", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "(?:creative commons attribution non ?commercial|cc by nc) 4 0(?: licen[sc]e)?", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "(?:creative commons attribution no ?deriv\\S*|cc by nd) 4 0(?: licen[sc]e)?", "creativecommons org licenses by nd 4 0"),
]

#: Ways to state a licence: form, priority, pattern.
FORMS = [
    ("identifier", 4, "spdx licen[sc]e identifier {id}"),
    ("address", 4, "(?:https? )?(?:www )?{address}"),
    ("notice", 3, "(?:licensed|released|distributed|available|published|provided|covered)(?: \\S+){{0,3}}? under (?:the )?(?:terms (?:of|and conditions of) (?:the )?)?{name}"),
    ("see", 3, "see (?:the )?(?:\\S+ ){{0,3}}?{name}"),
    ("named", 2, "{name}"),
]

#: label, priority, pattern of statements that name no licence.
GENERAL = [
    ("mit", 2, "mit licen[sc]e"),
    ("apache", 1, "apache(?: software)? licen[sc]e"),
    ("gpl", 1, "(?:gnu )?general public licen[sc]e"),
    ("lgpl", 1, "(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("agpl", 1, "(?:gnu )?affero general public licen[sc]e"),
    ("bsd", 1, "bsd(?: style)? licen[sc]e"),
    ("mit", 3, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 3, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", 3, "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("public-domain", 2, "(?:released|dedicated|placed|put)(?: \\S+){0,3}? (?:in|into|to) the public domain"),
    ("public-domain", 1, "public domain"),
    ("proprietary", 2, "all rights reserved"),
    ("proprietary", 2, "proprietary(?: and)?(?: confidential)? licen[sc]e"),
    ("proprietary", 2, "end user licen[sc]e agreement"),
    ("warranty-disclaimer", 2, "(?:software )?(?:is )?provided as is(?: without warranty of any kind)?"),
    ("warranty-disclaimer", 1, "without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    ("copyright", 1, "copyright(?: c)?(?: \\d{4})(?: \\d{4}){0,8}"),
    ("license-file", 1, "see (?:the )?licen[sc]e(?: txt| md)?(?: file)?(?: for details)"),
    ("licensed", 1, "licensed under(?: the)?"),
]

#: label, priority, pattern of sentences that stand in licence texts and in the notices of source files, by family.
SENTENCES = [
    # MIT and its relatives
    ("mit", 3, "to deal in the software without restriction including without limitation the rights to use"),
    ("mit", 3, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 2, "(?:this|the) (?:software|project|package|library|code) is (?:licensed|released|distributed) under the (?:terms of the )?mit licen[sc]e"),
    ("mit", 2, "(?:dual|tri) licensed under (?:the )?mit"),
    ("mit", 2, "use of this source code is governed by an? mit style licen[sc]e"),
    ("mit-x11", 3, "except as contained in this notice the name of the \\S+ shall not be used in advertising"),
    ("mit-x11", 2, "x11 licen[sc]e"),
    ("mit-modern", 2, "mit modern variant"),
    ("mit-advertising", 2, "this permission notice shall be included in all copies of the software and its documentation"),
    ("isc", 3, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", 2, "internet (?:systems|software) consortium licen[sc]e"),
    ("historical-permission", 3, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("historical-permission", 2, "no representations about the suitability of this software for any purpose"),
    # BSD
    ("bsd", 3, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 2, "redistribution and use in source and binary forms"),
    ("bsd", 2, "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)?(?: as is)?"),
    ("bsd", 2, "use of this source code is governed by an? bsd style licen[sc]e"),
    ("bsd-3-clause", 3, "neither the names? of (?:\\S+ ){1,12}?nor the names? of (?:its|the|their|any) contributors"),
    ("bsd-3-clause", 3, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", 3, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", 3, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", 3, "this product includes software developed by the university of california"),
    ("bsd-2-clause-views", 3, "the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-patent", 3, "a copyright licen[sc]e and a patent licen[sc]e under the terms of the bsd"),
    ("bsd", 2, "berkeley software distribution"),
    # Apache
    ("apache-2.0", 3, "licensed under the apache licen[sc]e version 2 0 the licen[sc]e"),
    ("apache-2.0", 3, "you may not use this (?:file|work|software) except in compliance with the licen[sc]e"),
    ("apache-2.0", 3, "you may obtain a copy of the licen[sc]e at https? www apache org"),
    ("apache-2.0", 3, "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache-2.0", 3, "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2.0", 3, "licensed to the apache software foundation (?:asf )?under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", 3, "grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e"),
    ("apache-2.0", 3, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", 2, "asl 2 0"),
    ("apache-1.1", 3, "this product includes software developed by the apache software foundation"),
    ("apache-1.1", 3, "products derived from this software may not be called apache"),
    ("apache-1.0", 3, "this product includes software developed by the apache group"),
    ("apache-2.0-llvm", 3, "apache licen[sc]e v2 0 with llvm exceptions?"),
    # GPL, LGPL, AGPL and their exceptions
    ("gpl", 3, "this program is free software you can redistribute it and or modify"),
    ("gpl", 3, "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 3, "you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", 2, "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("gpl", 2, "the gnu general public licen[sc]e is a free copyleft licen[sc]e"),
    ("gpl", 2, "gnu gpl"),
    ("gpl-2.0-or-later", 3, "either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0-or-later", 3, "gpl v?2(?: 0)? (?:or later|plus)"),
    ("gpl-2.0-only", 3, "under the terms of version 2 of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl-2.0-only", 3, "gpl v?2(?: 0)? only"),
    ("gpl-3.0-or-later", 3, "either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", 3, "gpl v?3(?: 0)? (?:or later|plus)"),
    ("gpl-3.0-only", 3, "gpl v?3(?: 0)? only"),
    ("gpl-2.0", 2, "gplv2"),
    ("gpl-3.0", 2, "gplv3"),
    ("lgpl-2.1", 2, "lgplv2 1"),
    ("lgpl-3.0", 2, "lgplv3"),
    ("agpl-3.0", 2, "agplv3"),
    ("lgpl", 3, "this library is free software you can redistribute it and or modify"),
    ("lgpl", 3, "under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation"),
    ("lgpl", 3, "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl-2.1-or-later", 3, "either version 2 1 of the licen[sc]e or at your option any later version"),
    ("agpl-3.0", 3, "under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
    ("agpl-3.0", 3, "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl-3.0", 3, "remote network interaction use with the gnu general public licen[sc]e"),
    ("classpath-exception", 3, "linking this library statically or dynamically with other modules is making a combined work"),
    ("classpath-exception", 3, "(?:with the )?classpath exception"),
    ("gcc-exception", 3, "gcc runtime library exception"),
    ("bison-exception", 3, "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("font-exception", 3, "if you create a document which uses this font and embed this font"),
    ("linux-syscall-note", 3, "linux syscall note"),
    ("autoconf-exception", 3, "as a special exception the free software foundation gives unlimited permission to copy"),
    ("openssl-exception", 3, "permission to link (?:the code of )?(?:this|the) (?:program|portions of this program) with the openssl"),
    ("gfdl", 3, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl", 2, "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl", 2, "gnu all permissive licen[sc]e"),
    ("fsf-unlimited", 3, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsf-address", 1, "free software foundation inc \\d+ (?:\\S+ ){1,6}?(?:boston|cambridge)"),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("mpl-2.0", 3, "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-2.0", 3, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", 3, "this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", 3, "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-1.0", 3, "the contents of this file are subject to the mozilla public licen[sc]e version 1 0"),
    ("npl-1.1", 3, "the contents of this file are subject to the netscape public licen[sc]e"),
    ("epl-1.0", 3, "made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", 3, "made available under the terms of the eclipse public licen[sc]e (?:v )?2 0"),
    ("epl-2.0", 3, "this source code may also be made available under the following secondary licenses"),
    ("edl-1.0", 3, "eclipse distribution licen[sc]e v ?1 0"),
    ("cddl-1.0", 3, "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl-1.1", 3, "cddl (?:version )?1 1"),
    ("ibmpl-1.0", 3, "ibm public licen[sc]e(?: version)? 1 0"),
    ("cpal-1.0", 3, "common public attribution licen[sc]e"),
    ("osl-3.0", 3, "open software licen[sc]e(?: version| v)? ?3 0"),
    ("afl-3.0", 3, "academic free licen[sc]e(?: version| v)? ?3 0"),
    ("eupl-1.1", 3, "eupl v? ?1 1"),
    ("cecill-2.1", 3, "cecill(?: free software)? licen[sc]e agreement"),
    ("cecill-b", 3, "cecill b"),
    ("cecill-c", 3, "cecill c"),
    ("ms-rl", 3, "microsoft reciprocal licen[sc]e"),
    ("apsl-2.0", 3, "apple public source licen[sc]e"),
    ("qpl-1.0", 3, "q public licen[sc]e"),
    ("sleepycat", 3, "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    # Permissive licences with wording of their own
    ("zlib", 3, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 3, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 3, "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", 3, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsl-1.0", 3, "distributed under the boost software licen[sc]e version 1 0"),
    ("unlicense", 3, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("0bsd", 3, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("curl", 3, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("python-2.0", 3, "psf licen[sc]e agreement for python"),
    ("python-2.0", 3, "psf is making python available to licensee on an as is basis"),
    ("ruby", 3, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("artistic-1.0", 3, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 3, "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed preamble this licen[sc]e establishes the terms"),
    ("perl", 3, "(?:under )?the same terms as perl itself"),
    ("php-3.01", 3, "this product includes php software freely available from"),
    ("php-3.01", 3, "this source file is subject to version 3 01 of the php licen[sc]e"),
    ("openssl", 3, "this product includes software developed by the openssl project"),
    ("ssleay", 3, "this product includes cryptographic software written by eric young"),
    ("openldap", 3, "openldap public licen[sc]e"),
    ("postgresql", 3, "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", 3, "to deal with the software without restriction"),
    ("icu", 3, "icu licen[sc]e icu 1 8 1 and later"),
    ("unicode-dfs", 3, "unicode inc licen[sc]e agreement data files and software"),
    ("w3c", 3, "w3c software (?:notice and licen[sc]e|licen[sc]e)"),
    ("vim", 3, "vim licen[sc]e"),
    ("tcl", 3, "tcl tk licen[sc]e"),
    ("libpng", 3, "libpng licen[sc]e"),
    ("libtiff", 3, "libtiff licen[sc]e"),
    ("ijg", 3, "this software is based in part on the work of the independent jpeg group"),
    ("ftl", 3, "freetype (?:project )?licen[sc]e"),
    ("info-zip", 3, "info zip licen[sc]e"),
    ("beerware", 3, "beer ?ware licen[sc]e"),
    ("beerware", 3, "you can buy me a beer in return"),
    ("json", 3, "the software shall be used for good not evil"),
    ("blueoak-1.0.0", 3, "blue oak model licen[sc]e"),
    ("mulanpsl-2.0", 3, "mulan (?:psl|permissive software licen[sc]e) v ?2"),
    ("upl-1.0", 3, "the universal permissive licen[sc]e upl version 1 0"),
    ("afpl", 3, "aladdin free public licen[sc]e"),
    # Content, data and models
    ("cc0-1.0", 3, "to the extent possible under law (?:\\S+ ){1,8}?waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", 3, "cc0 1 0 universal(?: public domain dedication)?"),
    ("cc-by-4.0", 3, "this work is licensed under a creative commons attribution 4 0 international licen[sc]e"),
    ("cc-by-3.0", 3, "this work is licensed under a creative commons attribution 3 0 unported licen[sc]e"),
    ("cc-by-sa-3.0", 3, "creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?"),
    ("cc-by-sa-4.0", 3, "this work is licensed under a creative commons attribution share ?alike 4 0 international licen[sc]e"),
    ("cc-by-nc-sa-4.0", 3, "creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd-4.0", 3, "creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa-4.0", 3, "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 3, "cc by nc nd 4 0"),
    ("cc", 2, "(?:under a|under the) creative commons(?: \\S+){0,4}? licen[sc]e"),
    ("cc", 2, "some rights reserved"),
    ("odbl-1.0", 3, "open (?:data commons open )?database licen[sc]e(?: odbl)?"),
    ("odc-by-1.0", 3, "open data commons attribution licen[sc]e"),
    ("pddl-1.0", 3, "public domain dedication and licen[sc]e pddl"),
    ("ofl-1.1", 3, "this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("ofl-1.1", 3, "the font software may be sold as part of a larger software package"),
    ("openrail", 3, "(?:creativeml|bigscience) open ?rail(?: m)?"),
    ("llama", 3, "llama (?:2|3|3 1|3 2) community licen[sc]e(?: agreement)?"),
    ("public-domain", 3, "this (?:file|work|software|code|document) is (?:hereby )?(?:in|placed in|released into|dedicated to) the public domain"),
    ("public-domain", 3, "the authors? disclaims? copyright to this source code"),
    ("public-domain", 3, "a work of the (?:u s|united states) government"),
    ("public-domain", 3, "no copyright is claimed"),
    # Commercial, source-available and rights statements
    ("busl-1.1", 3, "business source licen[sc]e(?: 1 1)?"),
    ("sspl-1.0", 3, "server side public licen[sc]e"),
    ("elastic-2.0", 3, "elastic licen[sc]e(?: version)? 2 0"),
    ("elastic-2.0", 3, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 3, "commons clause licen[sc]e condition"),
    ("polyform", 3, "polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use)"),
    ("prosperity", 3, "prosperity public licen[sc]e"),
    ("parity", 3, "parity public licen[sc]e"),
    ("hippocratic", 3, "hippocratic licen[sc]e"),
    ("proprietary", 3, "this software is the confidential and proprietary information of"),
    ("proprietary", 3, "(?:unauthori[sz]ed|any) (?:copying|reproduction|use|distribution)(?: of this \\S+)?(?: via any medium)? is strictly prohibited"),
    ("proprietary", 3, "no part of this (?:publication|book|work|document|software) may be reproduced"),
    ("proprietary", 3, "trade secrets? (?:and|or) confidential information of"),
    ("proprietary", 2, "not for (?:resale|redistribution|public release)"),
    ("proprietary", 2, "for internal use only"),
    ("proprietary", 2, "commercial licen[sc]e agreement"),
    ("proprietary", 2, "by (?:installing|downloading|using)(?: or \\S+){0,2} this software you (?:agree|accept)"),
    ("non-commercial", 2, "for non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", 2, "for (?:personal|academic|research|educational)(?: (?:and|or) \\S+)?(?: use| purposes) only"),
    ("non-commercial", 2, "may not be used for commercial purposes"),
    ("proprietary", 1, "reproduced with permission"),
    ("proprietary", 1, "used (?:by|with) permission"),
    # Warranty and liability
    ("warranty-disclaimer", 2, "including but not limited to the (?:implied )?warranties of merchantability"),
    ("warranty-disclaimer", 2, "merchantability(?: and| or)? fitness for a particular purpose"),
    ("warranty-disclaimer", 2, "without warranties or conditions of any kind"),
    ("warranty-disclaimer", 2, "express or implied warrant(?:y|ies)"),
    ("warranty-disclaimer", 2, "use (?:it )?at your own risk"),
    ("warranty-disclaimer", 2, "in no event shall (?:\\S+ ){1,10}?be liable for any"),
    ("warranty-disclaimer", 1, "disclaimer of warrant(?:y|ies)"),
    ("warranty-disclaimer", 1, "limitation of liability"),
    ("copyright", 1, "all contents? (?:is |are )?copyright"),
    ("copyright", 1, "the (?:respective )?copyright (?:holders?|owners?)"),
    ("copyright", 1, "portions copyright"),
    ("license-file", 2, "(?:see|read)(?: the)? (?:accompanying )?(?:file )?(?:licen[sc]e|copying|notice)(?: txt| md)? (?:file )?(?:in the root|for (?:details|more|the full|licen[sc]e))"),
    ("license-file", 2, "found in the licen[sc]e file"),
    ("license-file", 1, "this licen[sc]e applies to"),
    ("licensed", 1, "licen[sc]e agreement"),
    ("licensed", 1, "(?:dual|multi) licensed"),
    ("licensed", 1, "at your option under the terms of either"),
    ("permission", 1, "permission is (?:hereby )?granted to"),
    ("permission", 1, "you are free to (?:share|copy|redistribute|adapt|remix)"),
]


def rules() -> list[Rule]:
    """All rules: every licence in every form, then the general ones and the sentences."""
    out = []
    for label, ident, name, address in LICENSES:
        for _, priority, form in FORMS:
            out.append(Rule(label, priority, form.format(id=ident, name=name, address=address)))
    out += [Rule(*g) for g in GENERAL + SENTENCES]
    return out
