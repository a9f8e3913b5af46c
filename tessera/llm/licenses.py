"""License scans by ordered signature rules, in DataFrame operations alone.

Texts become lower-case words joined by single spaces, only where a rule's keyword occurs. Each rule is a regular
expression over those words with a keyword and a priority; a text meets only the rules whose keyword it holds. Rules
are hand-written notices, names and single wordings, and families of names, versions and scopes. Detections are taken by
priority, then longest first, then leftmost, then in the order of the rules (so ties have one result): one that overlaps a
detection of higher priority goes, wherever it starts, and so does one inside another of its own priority.

Nulls and empty texts have no words and no labels. Repeated rows give equal rows. An empty table gives no rows. Texts are
scanned whole, however long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash

# Fixed base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed families: label, keyword, names, versions. A name is a wording over lower-case words.
FAMILIES = [
    ("gpl", "gnu", ["gnu general public licen[cs]e", "gnu gpl"], ["1.0", "2.0", "3.0"]),
    ("gpl", "gpl", ["gpl", "general public licen[cs]e gpl"], ["1.0", "2.0", "3.0"]),
    ("lgpl", "gnu", ["gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "gnu lgpl"], ["2.0", "2.1", "3.0"]),
    ("lgpl", "lgpl", ["lgpl"], ["2.0", "2.1", "3.0"]),
    ("agpl", "affero", ["(?:gnu )?affero general public licen[cs]e"], ["1.0", "3.0"]),
    ("agpl", "agpl", ["agpl"], ["1.0", "3.0"]),
    ("gfdl", "gnu", ["gnu free documentation licen[cs]e"], ["1.1", "1.2", "1.3"]),
    ("apache", "apache", ["apache(?: software)? licen[cs]e", "apache"], ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla", ["mozilla public licen[cs]e"], ["1.0", "1.1", "2.0"]),
    ("mpl", "mpl", ["mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", ["eclipse public licen[cs]e"], ["1.0", "2.0"]),
    ("eupl", "european", ["european union public licen[cs]e"], ["1.0", "1.1", "1.2"]),
    ("cddl", "distribution", ["common development and distribution licen[cs]e"], ["1.0", "1.1"]),
    ("cpl", "common public", ["common public licen[cs]e"], ["1.0"]),
    ("artistic", "artistic", ["(?:the )?artistic licen[cs]e"], ["1.0", "2.0"]),
    ("afl", "academic free", ["academic free licen[cs]e"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("osl", "open software", ["open software licen[cs]e"], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("bsl", "boost", ["boost software licen[cs]e"], ["1.0"]),
    ("ofl", "font", ["(?:sil )?open font licen[cs]e"], ["1.0", "1.1"]),
    ("php", "php", ["php licen[cs]e"], ["3.0", "3.01"]),
    ("cecill", "cecill", ["cecill(?: free software licen[cs]e)?"], ["1.0", "1.1", "2.0", "2.1"]),
    ("odbl", "database", ["open (?:data commons )?open database licen[cs]e", "open database licen[cs]e"], ["1.0"]),
    ("python", "python", ["python software foundation licen[cs]e"], ["2.0"]),
    ("python", "psf", ["psf licen[cs]e"], ["2.0"]),
    ("zpl", "zope", ["zope public licen[cs]e"], ["1.1", "2.0", "2.1"]),
    ("lppl", "latex", ["latex project public licen[cs]e"], ["1.0", "1.1", "1.2", "1.3"]),
    ("apsl", "apple", ["apple public source licen[cs]e"], ["1.0", "1.1", "1.2", "2.0"]),
    ("spl", "sun public", ["sun public licen[cs]e"], ["1.0"]),
    ("nasa", "nasa", ["nasa open source agreement"], ["1.3"]),
]

# Fixed Creative Commons elements in both wordings.
CC = {
    "by": ("by", "attribution"),
    "by-sa": ("by sa", "attribution share ?alike"),
    "by-nc": ("by nc", "attribution non ?commercial"),
    "by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

# Fixed single signatures: label, keyword, wording.
SINGLES = [
    ("mit", "mit", "(?:the )?mit licen[cs]e"),
    ("mit", "mit", "licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit"),
    ("mit", "mit", "(?:released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?"),
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "as is", "the software is provided as is without warranty of any kind express or implied"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("isc", "isc", "isc licen[cs]e"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-0-clause", "bsd", "(?:bsd (?:0|zero) clause|(?:0|zero) clause bsd|0bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released into|placed in|dedicated to|in) the public domain"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons", "creative commons zero(?: v?1 0)?(?: universal)?"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("vim", "vim", "vim licen[cs]e"),
    ("w3c", "w3c", "w3c software notice and licen[cs]e"),
    ("qpl", "q public", "q public licen[cs]e"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("no-commercial-use", "commercial use", "(?:no|not for) commercial use"),
    ("proprietary", "proprietary", "proprietary and confidential"),
]

# Fixed sentences of notices and grants: label, keyword, wording (marks are spaces in the text that rules meet).
NOTICES = [
    ("gpl", "free software", "this (?:program|library|package|file) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-3.0-or-later", "either version 3", "gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-2.0-or-later", "either version 2", "gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-2.0-only", "version 2", "gnu general public licen[cs]e version 2 as published by the free software foundation"),
    ("gpl", "copy of the gnu", "you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|package|file)"),
    ("lgpl", "copy of the gnu", "you should have received a copy of the gnu lesser general public licen[cs]e along with this (?:program|library|package|file)"),
    ("lgpl", "free software", "this (?:program|library|package|file) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("lgpl-2.1-or-later", "either version 2 1", "gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version"),
    ("agpl", "copy of the gnu", "you should have received a copy of the gnu affero general public licen[cs]e along with this (?:program|library|package|file)"),
    ("agpl-3.0-or-later", "affero", "gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-with-exception", "special exception", "as a special exception (?:to|the|if|you|linking)"),
    ("gpl-with-classpath-exception", "classpath", "gnu general public licen[cs]e (?:version 2 )?with (?:the )?classpath exception"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("apache-2.0", "apache", "licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "apache org licenses", "www apache org licenses licen[cs]e 2 0"),
    ("apache", "apache software foundation", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v ?2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-2.0-no-copyleft-exception", "incompatible with secondary", "this source code form is incompatible with secondary licenses"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public licen[cs]e (?:v )?2 0"),
    ("cddl", "common development", "this file and its contents are supplied under the terms of the common development and distribution licen[cs]e"),
    ("bsd-3-clause", "endorse or promote", "neither the name of .{1,80} nor the names of (?:its|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "governed by a bsd", "use of this source code is governed by a bsd style licen[cs]e"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("x11", "dealings in this software", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost", "distributed under the boost software licen[cs]e version 1 0"),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the", "do what the f?u?c?k? ?you want to public licen[cs]e"),
    ("beerware", "beer", "(?:the )?beer ?ware licen[cs]e"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("cc0", "neighboring rights", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc0", "public domain", "no rights reserved public domain dedication"),
    ("public-domain", "public domain", "this (?:work|file|code|software|document) is (?:in )?(?:the )?public domain"),
    ("public-domain", "public domain", "hereby (?:placed|released|put) (?:in|into) the public domain"),
    ("cc", "creative commons", "this work is licensed under a creative commons"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("isc", "disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "without fee", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "without fee", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("ofl", "reserved font name", "with reserved font names?"),
    ("artistic", "same terms as perl", "(?:under )?the same terms as perl(?: 5)?(?: itself)?"),
    ("python", "python", "this software is distributed under the same licen[cs]e as python"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("openssl", "eric young", "includes cryptographic software written by eric young"),
    ("icu", "unicode", "unicode data files and software licen[cs]e"),
    ("libpng", "libpng", "if you modify libpng you may insert additional notices"),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "portions of this software are copyright (?:c )?[0-9]{4}(?: [0-9]{4})? the freetype project"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("commons-clause", "commons clause", "(?:with |the )?commons clause(?: licen[cs]e)?(?: condition)?"),
    ("elastic-2.0", "elastic", "elastic licen[cs]e (?:2 0|v2)"),
    ("sspl-1.0", "server side public", "server side public licen[cs]e(?: v(?:ersion )?1)?"),
    ("busl-1.1", "business source", "business source licen[cs]e(?: 1 1)?"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary", "contains (?:confidential and proprietary|proprietary) (?:information|trade secrets?)"),
    ("proprietary", "may not be reproduced", "may not be reproduced (?:or transmitted |distributed or transmitted )?in any form or by any means"),
    ("proprietary", "prior written permission", "without the prior written permission of the (?:publisher|author|copyright (?:holder|owner))"),
    ("proprietary", "for internal use", "for internal use only"),
    ("no-commercial-use", "commercial use", "for (?:personal )?(?:and )?non ?commercial use only"),
    ("no-commercial-use", "noncommercial", "for (?:personal and )?noncommercial use only"),
    ("no-derivatives", "derivative works", "no derivative works (?:are )?(?:allowed|permitted)"),
    ("research-only", "purposes only", "for (?:academic|research|non commercial research)(?: and (?:academic|research))? purposes only"),
    ("evaluation-only", "evaluation purposes", "for evaluation purposes only"),
    ("attribution", "with attribution", "free to use with attribution"),
    ("reproduction", "reproduced with", "reproduced with (?:the )?(?:kind )?permission"),
    ("crown-copyright", "crown copyright", "crown copyright"),
    ("ogl-uk", "open government", "open government licen[cs]e(?: v(?:ersion )?[123] ?0?)?"),
    ("us-government-work", "united states government", "(?:is )?a work of the united states government"),
    ("eula", "end user", "end user licen[cs]e agreement"),
    ("fair-use", "fair use", "(?:under|for) (?:the )?fair use"),
    ("opl", "open publication", "open publication licen[cs]e(?: v(?:ersion )?[0-9] [0-9])?"),
]

# Fixed names of further licenses: label and name; the keyword is the name's first words.
NAMES = {
    "adobe": "adobe (?:utopia|glyph list|postscript afm) licen[cs]e", "aladdin": "aladdin free public licen[cs]e", "apl": "adaptive public licen[cs]e", "attribution-assurance": "attribution assurance licen[cs]e",
    "bittorrent": "bittorrent open source licen[cs]e", "blueoak": "blue oak model licen[cs]e", "catosl": "computer associates trusted open source licen[cs]e", "caldera": "caldera licen[cs]e", "cal": "cryptographic autonomy licen[cs]e",
    "cua-opl": "cua office public licen[cs]e", "d-fsl": "deutsche freie software lizenz", "doc": "doc software licen[cs]e", "ecl": "educational community licen[cs]e", "efl": "eiffel forum licen[cs]e", "entessa": "entessa public licen[cs]e",
    "erlang": "erlang public licen[cs]e", "eudatagrid": "eu datagrid software licen[cs]e", "fair": "fair licen[cs]e", "frameworx": "frameworx open licen[cs]e", "fal": "free art licen[cs]e", "fsl": "functional source licen[cs]e",
    "gust-font": "gust font licen[cs]e", "hippocratic": "hippocratic licen[cs]e", "ibm-pl": "ibm public licen[cs]e", "imatix": "imatix standard function library agreement", "informal": "intel open source licen[cs]e", "interbase": "interbase public licen[cs]e",
    "ipa": "ipa font licen[cs]e", "jam": "jam licen[cs]e", "jasper": "jasper licen[cs]e", "liliq": "licence libre du québec", "lpl": "lucent public licen[cs]e", "miros": "miros licen[cs]e", "motosoto": "motosoto open source licen[cs]e",
    "mulan": "mulan permissive software licen[cs]e", "multics": "multics licen[cs]e", "naumen": "naumen public licen[cs]e", "netscape": "netscape public licen[cs]e", "ngpl": "nethack general public licen[cs]e", "nokia": "nokia open source licen[cs]e",
    "nposl": "non profit open software licen[cs]e", "oclc": "oclc research public licen[cs]e", "odc-by": "open data commons attribution licen[cs]e", "pddl": "open data commons public domain dedication", "ogtsl": "open group test suite licen[cs]e",
    "oldap": "openldap public licen[cs]e", "oset": "oset public licen[cs]e", "parity": "parity public licen[cs]e", "polyform-noncommercial": "polyform noncommercial licen[cs]e", "polyform-small-business": "polyform small business licen[cs]e",
    "prosperity": "prosperity public licen[cs]e", "realnetworks": "realnetworks public source licen[cs]e", "ricoh": "ricoh source code public licen[cs]e", "rpl": "reciprocal public licen[cs]e", "simpl": "simple public licen[cs]e",
    "sissl": "sun industry standards source licen[cs]e", "sleepycat": "sleepycat licen[cs]e", "sgi-b": "sgi free software licen[cs]e", "tcl": "tcl tk licen[cs]e", "ucl": "upstream compatibility licen[cs]e", "unicode": "unicode licen[cs]e",
    "upl": "universal permissive licen[cs]e", "vovida": "vovida software licen[cs]e", "watcom": "sybase open watcom public licen[cs]e", "wxwindows": "wxwindows library licen[cs]e", "xfree86": "xfree86 licen[cs]e", "xnet": "x net licen[cs]e",
    "yahoo": "yahoo public licen[cs]e", "zend": "zend licen[cs]e", "cdla-permissive": "community data licen[cs]e agreement permissive", "cdla-sharing": "community data licen[cs]e agreement sharing", "open-rail": "openrail licen[cs]e",
    "llama": "llama [23](?: [0-9])? community licen[cs]e", "gemma": "gemma terms of use", "ms-lpl": "microsoft limited public licen[cs]e", "nvidia": "nvidia source code licen[cs]e", "intel": "intel simplified software licen[cs]e",
}


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str


def _version(v: str) -> str:
    major, minor = v.split(".")
    return f"{major}(?: {minor})?" if set(minor) == {"0"} else f"{major} {minor}"


def rules() -> list[Rule]:
    """All signatures, most specific first: a version with its scope, a version, a bare name, identifiers of SPDX tags."""
    out: list[Rule] = []
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            for v in versions:
                at = rf"{name},? ?(?:v|ver |version |v )?{_version(v)}"
                out.append(Rule(1, f"{label}-{v}-or-later", keyword, rf"{at} (?:or (?:\(at your option\) )?(?:at your option )?(?:any )?later(?: version)?|or newer)"))
                out.append(Rule(1, f"{label}-{v}-only", keyword, rf"{at} only"))
                out.append(Rule(2, f"{label}-{v}", keyword, at))
            if name != "apache":
                out.append(Rule(3, label, keyword, name))
    for kind, (short, long) in CC.items():
        for v in CC_VERSIONS:
            out.append(Rule(2, f"cc-{kind}-{v}", "cc", rf"cc {short} {_version(v)}"))
            out.append(Rule(2, f"cc-{kind}-{v}", "creative commons", rf"creative commons {long} {_version(v)}(?: international| unported| generic)?"))
        out.append(Rule(3, f"cc-{kind}", "cc", rf"cc {short}"))
        out.append(Rule(3, f"cc-{kind}", "creative commons", rf"creative commons {long}"))
    out += [Rule(2, label, keyword, wording) for label, keyword, wording in [*SINGLES, *NOTICES]]
    out += [Rule(2, label, name.split(" ")[0], name) for label, name in NAMES.items()]
    labels = dict.fromkeys(r.label for r in out)
    out += [Rule(0, label, "spdx", "spdx licen[cs]e identifier " + "[ ]?".join(label.replace(".", " ").replace("-", " ").split(" "))) for label in labels]
    return out


def _gate(all_rules: list[Rule]) -> str:
    """A cheap test on the raw text that every text with a rule's keyword or a base phrase passes.

    Signatures start at word starts, so only those are tried; words that merely end in a keyword are named in full.
    """
    gap = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
    # rules whose wording always has the word license in it pass by that word
    others = [r for r in all_rules if "licen[cs]e" not in re.sub(r"\(\?:[^()]*\)\?", "", r.pattern)]
    loose = {r.keyword.replace(" ", gap) for r in others} - {"mit", "cc"}
    under_mit = f"under{gap}(?:the{gap})?(?:terms{gap}of{gap}(?:the{gap})?)?mit"
    return rf"(?i)(?<![0-9a-z])(?:licen[cs]|cc[^0-9a-z]+by|freebsd|0bsd|mit{gap}no|{under_mit}|" + "|".join(sorted(loose)) + ")"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)``; words count from 0."""
    spark = docs.sparkSession
    signatures = rules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    lowered = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    a = base.select("doc_id", F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), F.when(F.col("t").rlike(_gate(signatures)), norm).alias("norm"))
    found = stash(a.select(F.monotonically_increasing_id().alias("row"), "*"), "license-texts")

    phrase = "(?<![^ ])(?:" + "|".join(BASE) + ")(?![^ ])"
    b = found.select("row", "doc_id", "n_words", "norm", F.when(F.col("norm").rlike(phrase), F.regexp_extract_all("norm", F.lit(phrase), F.lit(0))).alias("v"))
    c = b.select("*", F.when(F.size("v") > 0, F.split("norm", phrase, -1)).alias("g"))
    names = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    placed = c.select(
        "row", "doc_id", "n_words",
        F.coalesce(F.size("v"), F.lit(0)).cast("long").alias("n_base"),
        _spaces(F.get("g", F.lit(0))).cast("long").alias("first_word"),
        (_spaces(F.col("norm")) - _spaces(F.element_at("g", -1)) - _spaces(F.element_at("v", -1))).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("v", F.lit([]).cast("array<string>")), lambda x: F.element_at(names, x)))).alias("base"),
    )

    table = spark.createDataFrame([(i, r.priority, r.label, r.keyword, rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for i, r in enumerate(signatures)], "rule int, priority int, label string, keyword string, pattern string")
    keywords = sorted({r.keyword for r in signatures})
    keyed = found.filter("norm is not null").select("row", "norm", F.explode(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("norm"), k))).alias("keyword"))
    met = keyed.join(F.broadcast(table), "keyword").filter(F.rlike("norm", F.col("pattern")))  # the rules are a fixed few hundred
    d = met.select("row", "rule", "priority", "label", F.regexp_extract_all("norm", F.col("pattern"), F.lit(0)).alias("v"), F.split("norm", F.col("pattern"), -1).alias("g"))
    spans = F.aggregate(
        F.sequence(F.lit(0), F.size("v") - 1),
        F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + _spaces(F.get("g", i)) + _spaces(F.get("v", i))).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + _spaces(F.get("g", i))).alias("start"), (acc["at"] + _spaces(F.get("g", i)) + _spaces(F.get("v", i)) + 1).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    each = d.select("row", "priority", "rule", "label", F.explode(spans).alias("s")).select("row", F.struct("priority", (F.col("s.start") - F.col("s.end")).alias("minus_length"), F.col("s.start").alias("start"), "rule", F.col("s.end").alias("end"), "label").alias("d"))
    per_row = each.groupBy("row").agg(F.array_sort(F.collect_list("d")).alias("all"))
    one = "struct<start:int,end:int,priority:int,label:string>"
    kept = F.aggregate(
        "all",
        F.lit([]).cast(f"array<{one}>"),
        lambda acc, x: F.when(F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]) & ((k["priority"] < x["priority"]) | ((k["start"] <= x["start"]) & (x["end"] <= k["end"])))), acc).otherwise(
            F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["priority"].alias("priority"), x["label"].alias("label"))))
        ),
        lambda acc: F.array_sort(acc),
    )
    joined = placed.join(per_row.select("row", kept.alias("detections")), "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.transform("detections", lambda x: x["label"]), F.lit([]).cast("array<string>")))))
    strength = F.array_max(F.transform("detections", lambda x: F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.05) * (x["end"] - x["start"]) + F.lit(0.1) * (3 - x["priority"]))))
    score = F.greatest(F.when(F.size("base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)), F.coalesce(strength, F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
