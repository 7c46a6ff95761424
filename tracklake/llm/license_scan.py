"""License scans: known sentences become identifiers, identifier sequences match ordered rules.

A text is cut into sentences in three ways: at line ends and after ``.!?`` before white
space; by paragraphs, whose lines are joined (a line without letters and digits ends one,
a list number begins a new sentence) and cut after ``.!?``; and so with ``;`` as a further
cut.  So notices of one line and texts wrapped at any width, with or without comment marks
that are no letters, are found alike.  A sentence is normalised (lower case, runs of other characters than letters and digits
become one space) and looked up among the known sentences; some hold a gap for any holder's
name; a notice may name several licences, as expressions of identifiers do; an unknown one
breaks a sequence.  The rules are tried in their order on each cut, and what a rule has matched is
taken out, so that a full licence text is not also reported as its parts; nor does a cut
report the parts of what only another one has in full.

Null and empty texts have no sentences and an empty result; every row is judged by
itself, so ties and repeated rows need no rule; a text of any length is read whole; an
empty table gives an empty one.  Extra columns are passed on; those of the names of the
added ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.components import unused


@dataclass(frozen=True)
class LicenseRule:
    rule: str
    license: str
    sentences: tuple[str, ...]


# Sentences of public licence texts and notices, normalised.
SENTENCES: dict[str, str] = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-notice-long": "licensed under the apache license version 2 0 the license",
    "apache2-compliance": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc4": "licensed under cc by nc 4 0",
    "cc-by4": "licensed under cc by 4 0",
    "cc-by-sa4": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights-reserved": "all rights reserved",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liable": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "unlicense-dedicate": "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl11-contents": "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license",
    "cddl-contents": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "epl2-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1-available": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-details": "see the gnu affero general public license for more details",
    # Heads of full texts, line by line and as one paragraph.
    "apache2-version": "version 2 0 january 2004",
    "apache2-head": "apache license version 2 0 january 2004 http www apache org licenses",
    "gpl-title": "gnu general public license",
    "lgpl-title": "gnu lesser general public license",
    "agpl-title": "gnu affero general public license",
    "gnu3-version": "version 3 29 june 2007",
    "agpl3-version": "version 3 19 november 2007",
    "gpl2-version": "version 2 june 1991",
    "lgpl21-version": "version 2 1 february 1999",
    "gpl3-head": "gnu general public license version 3 29 june 2007",
    "gpl2-head": "gnu general public license version 2 june 1991",
    "lgpl3-head": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-head": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-head": "gnu affero general public license version 3 19 november 2007",
    "mpl2-title": "mozilla public license version 2 0",
}

# Sentences with a gap for a holder, as a part that each has, and their pattern.
GAPS: dict[str, tuple[str, str]] = {
    "bsd-endorse": (
        "endorse or promote products derived from this software",
        "^(?:[0-9] )?(?:neither the names? of .{1,200} nor the names of (?:its|any|their|other) (?:contributors|authors|developers)|the names? of .{1,200}) may (?:not )?be used to endorse or promote products derived from this software without (?:specific )?prior written permission$",
    )
}

# Licences by their public identifiers, with their names as they stand in notices.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit licence", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license", "3 clause bsd license"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl v2", "gplv2", "gpl 2 0"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl v3", "gplv3", "gpl 3 0"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgpl 2 1", "lgplv2 1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgpl 3 0", "lgplv3"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl 3 0", "agplv3"),
    "MPL-1.1": ("mozilla public license version 1 1", "mpl 1 1"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-1.0": ("eclipse public license v1 0", "eclipse public license version 1 0", "eclipse public license 1 0"),
    "EPL-2.0": ("eclipse public license v2 0", "eclipse public license version 2 0", "eclipse public license 2 0"),
    "CDDL-1.0": ("common development and distribution license", "cddl 1 0"),
    "ISC": ("isc license", "isc licence"),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Unlicense": ("unlicense", "unlicence"),
    "PostgreSQL": ("postgresql license",),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "PSF-2.0": ("python software foundation license version 2", "psf license"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
    "0BSD": ("bsd zero clause license", "zero clause bsd license"),
    "CC0-1.0": ("creative commons zero v1 0 universal license", "cc0 1 0 universal license", "cc0 license", "cc0 1 0"),
    **{
        f"CC-{short.upper().replace(' ', '-')}-{v}": (
            f"creative commons {long} {v.replace('.', ' ')} international license", f"creative commons {long} {v.replace('.', ' ')} license", f"creative commons {long} {v.replace('.', ' ')} unported license", f"cc {short} {v.replace('.', ' ')} license", f"cc {short} {v.replace('.', ' ')}",
        )
        for short, long in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
        for v in ("3.0", "4.0")
    },
    **{
        f"{short}-{v}-or-later": tuple(f"{name} {mark}{n} or {later}" for name in (f"gnu {long}", f"gnu {short.lower()}", short.lower()) for n in dict.fromkeys((v.replace(".", " "), v.removesuffix(".0").replace(".", " "))) for mark in ("version ", "v") for later in ("later", "any later version"))
        for short, long, versions in (("GPL", "general public license", ("2.0", "3.0")), ("LGPL", "lesser general public license", ("2.1", "3.0")), ("AGPL", "affero general public license", ("3.0",)))
        for v in versions
    },
}
#: What may follow a licence's name in its notice, and what parts the names of several; "or later" is part of a name.
TAIL, BETWEEN = " (?:see|as published by|which|a copy of which|found in|included in|whose|in the file) .*$", " (?:or|and|with) (?:the )?"
_LATER = (" or later", " or any later version")
#: A notice of one sentence: what it is, how it is given, and the name of a licence.
NOTICE = r"^(?:this (?:work|project|software|file|code|program|library|package) is )?(?:licensed|released|distributed|made available|available|published) under (?:the terms of )?(?:the |a )?(.+)$|^spdx license identifier (.+)$"


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def _free(subject: str, gnu: str, version: str) -> str:
    return f"this {subject} is free software you can redistribute it and or modify it under the terms of the gnu {gnu} as published by the free software foundation either version {version} of the license or at your option any later version"


#: Grants of the GNU licences: identifier, name and version.
GNU = tuple((f"{short}-{v}-or-later", name, v.removesuffix(".0").replace(".", " ")) for short, name, versions in (("GPL", "general public license", ("2.0", "3.0")), ("LGPL", "lesser general public license", ("2.1", "3.0")), ("AGPL", "affero general public license", ("3.0",))) for v in versions)


def known_names() -> dict[str, str]:
    """Name of a licence, as it stands in notices, to the identifier of a notice of it."""
    return {n: f"notice-{k}" for k, names in NAMES.items() for n in (*names, _plain(k))}


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: grants by their subjects, and the fixed sentences."""
    free = {_free(subject, name, v): f"free-{k}" for k, name, v in GNU for subject in ("program", "library", "software", "file", "project", "package")}
    only = {
        f"this {subject} is free software you can redistribute it and or modify it under the terms of {terms} as published by the free software foundation": f"free-{short}-{v}-only"
        for short, name, versions in (("GPL", "general public license", ("2.0", "3.0")), ("LGPL", "lesser general public license", ("2.1", "3.0")), ("AGPL", "affero general public license", ("3.0",)))
        for v in versions
        for n in (v.removesuffix(".0").replace(".", " "),)
        for subject in ("program", "library", "software", "file", "project", "package")
        for terms in (f"the gnu {name} version {n}", f"version {n} of the gnu {name}")
    }
    return free | only | {v: k for k, v in SENTENCES.items()}


KNOWN, KNOWN_NAMES = known_sentences(), known_names()

#: Tried in this order; a rule's sentences must follow each other.
RULES: tuple[LicenseRule, ...] = (
    LicenseRule("apache-2.0-header", "Apache-2.0", ("apache2-notice-long", "apache2-compliance")),
    LicenseRule("apache-2.0-long-notice", "Apache-2.0", ("apache2-notice-long",)),
    LicenseRule("mit-text", "MIT", ("mit-grant", "mit-condition", "mit-asis")),
    LicenseRule("mit-grant", "MIT", ("mit-grant",)),
    LicenseRule("isc-text", "ISC", ("isc-grant", "isc-asis")),
    LicenseRule("isc-grant", "ISC", ("isc-grant",)),
    LicenseRule("gpl-3.0-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    LicenseRule("gpl-3.0-free", "GPL-3.0-or-later", ("gpl-free",)),
    LicenseRule("gpl-2.0-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    LicenseRule("gpl-2.0-free", "GPL-2.0-or-later", ("gpl2-free",)),
    *(LicenseRule(f"{k.lower()}-header", k, (f"free-{k}", hope, details)) for k, _, _ in GNU for hope, details in (("lgpl-hope", "lgpl-details"),) if k[0] == "L"),
    *(LicenseRule(f"{k.lower()}-header", k, (f"free-{k}", "gpl-hope", "agpl-details")) for k, _, _ in GNU if k[0] == "A"),
    *(LicenseRule(f"{k.lower()}-free", k, (f"free-{k}",)) for k, _, _ in GNU),
    *(LicenseRule(f"{k.lower()}-free", k, (f"free-{k}",)) for k in ("GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only")),
    LicenseRule("apache-2.0-text", "Apache-2.0", ("apache2-version",)),
    LicenseRule("apache-2.0-text-head", "Apache-2.0", ("apache2-head",)),
    LicenseRule("gpl-3.0-text", "GPL-3.0-only", ("gpl-title", "gnu3-version")),
    LicenseRule("gpl-3.0-text-head", "GPL-3.0-only", ("gpl3-head",)),
    LicenseRule("gpl-2.0-text", "GPL-2.0-only", ("gpl-title", "gpl2-version")),
    LicenseRule("gpl-2.0-text-head", "GPL-2.0-only", ("gpl2-head",)),
    LicenseRule("lgpl-3.0-text", "LGPL-3.0-only", ("lgpl-title", "gnu3-version")),
    LicenseRule("lgpl-3.0-text-head", "LGPL-3.0-only", ("lgpl3-head",)),
    LicenseRule("lgpl-2.1-text", "LGPL-2.1-only", ("lgpl-title", "lgpl21-version")),
    LicenseRule("lgpl-2.1-text-head", "LGPL-2.1-only", ("lgpl21-head",)),
    LicenseRule("agpl-3.0-text", "AGPL-3.0-only", ("agpl-title", "agpl3-version")),
    LicenseRule("agpl-3.0-text-head", "AGPL-3.0-only", ("agpl3-head",)),
    LicenseRule("mpl-2.0-text", "MPL-2.0", ("mpl2-title",)),
    LicenseRule("bsd-4-text", "BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising")),
    LicenseRule("bsd-3-text", "BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    LicenseRule("bsd-2-text", "BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    LicenseRule("unlicense-text", "Unlicense", ("unlicense-free", "unlicense-anyone")),
    LicenseRule("unlicense-free", "Unlicense", ("unlicense-free",)),
    LicenseRule("zlib-text", "Zlib", ("zlib-asis", "zlib-liable", "zlib-grant")),
    LicenseRule("boost-grant", "BSL-1.0", ("boost-grant",)),
    LicenseRule("postgresql-grant", "PostgreSQL", ("postgresql-grant",)),
    LicenseRule("mpl-2.0-header", "MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    LicenseRule("mpl-2.0-header-http", "MPL-2.0", ("mpl2-notice", "mpl2-copy-http")),
    LicenseRule("mpl-1.1-header", "MPL-1.1", ("mpl11-contents",)),
    LicenseRule("cddl-1.0-header", "CDDL-1.0", ("cddl-contents",)),
    LicenseRule("epl-2.0-header", "EPL-2.0", ("epl2-available",)),
    LicenseRule("epl-1.0-header", "EPL-1.0", ("epl1-available",)),
    LicenseRule("apache-2.0-notice", "Apache-2.0", ("apache2-notice",)),
    LicenseRule("mit-notice", "MIT", ("mit-notice",)),
    LicenseRule("mit-licensed", "MIT", ("mit-licensed",)),
    LicenseRule("mit-title", "MIT", ("mit-title",)),
    LicenseRule("gpl-3.0-notice", "GPL-3.0-only", ("gpl3-notice",)),
    LicenseRule("gpl-3.0-licensed", "GPL-3.0-only", ("gpl3-licensed",)),
    LicenseRule("cc-by-nc-4.0", "CC-BY-NC-4.0", ("cc-by-nc4",)),
    LicenseRule("cc-by-4.0", "CC-BY-4.0", ("cc-by4",)),
    LicenseRule("cc-by-sa-4.0", "CC-BY-SA-4.0", ("cc-by-sa4",)),
    LicenseRule("cc0-1.0", "CC0-1.0", ("cc0",)),
    LicenseRule("mpl-2.0", "MPL-2.0", ("mpl2-notice",)),
    LicenseRule("all-rights-reserved", "proprietary", ("rights-reserved",)),
    *(LicenseRule(f"{k.lower()}-named", k, (f"notice-{k}",)) for k in NAMES),
)

#: Short forms whose point does not end a sentence.
SHORT = ("v", "ver", "no", "inc", "ltd", "corp", "co", "e.g", "i.e")
_END = "(?<=[.!?])" + "".join(rf"(?<!(?<![\p{{L}}\p{{N}}])(?i:{x.replace('.', chr(92) + '.')})\.)" for x in SHORT) + r"\s+"
CUT = r"\n+|" + _END
PARAGRAPH_CUT = r"\n[^\p{L}\p{N}\n]*(?:\d{1,2}|[A-Za-z])[.)][ \t]+|\n[^\p{L}\p{N}\n]*(?=\n)|" + _END
CLAUSE_CUT = PARAGRAPH_CUT + "|;"


def telling_words(sentences: dict[str, str]) -> list[str]:
    """Words of which every known sentence has one, chosen by how many have them; those of notices besides."""
    left, out = [set(s.split()) for s in sentences], ["under", "spdx", *(part.split()[0] for part, _ in GAPS.values())]
    while left := [words for words in left if not words.intersection(out)]:
        counts = Counter(w for words in left for w in words if len(w) > 4 or max(map(len, words)) <= 4)
        out.append(min(counts, key=lambda w: (-counts[w], w)))
    return out


def sentence_ids(text: Column, sentences: dict[str, str] = KNOWN, names: dict[str, str] = KNOWN_NAMES, cut: str = CUT) -> Column:
    """The identifiers of the sentences of a text in their order; '' for a sentence that is not known."""
    table, named = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (sentences, names))
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}]+", " "))
    name = lambda p: F.concat(F.regexp_extract(p, NOTICE, 1), F.regexp_extract(p, NOTICE, 2))
    # The tests by words and by a hash set come first: the maps are searched for few sentences.

    def several(p: Column) -> Column:
        """The notices of one sentence, of each name that it gives."""
        held = name(p)
        for k, later in enumerate(_LATER):
            held = F.replace(held, F.lit(later), F.lit(chr(1 + k)))
        each = F.split(F.regexp_replace(held, TAIL, ""), BETWEEN)
        for k, later in enumerate(_LATER):
            each = F.transform(each, lambda x: F.replace(x, F.lit(chr(1 + k)), F.lit(later)))  # noqa: B023
        return F.array_join(F.transform(each, lambda x: F.try_element_at(named, x)), "||")

    notice = lambda p: F.coalesce(F.when(p.contains(" under ") | p.startswith("spdx "), several(p)), F.lit(""))

    def known(p: Column) -> Column:
        out = F.when(p.isin(*sentences), F.try_element_at(table, p))
        for k, (part, pattern) in GAPS.items():
            out = out.when(p.contains(part) & p.rlike(pattern), k)
        return out.otherwise(notice(p))

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), cut), lambda s: F.length(F.trim(s)) > 0)
    if cut == CUT:
        return F.transform(parts, lambda s: known(plain(s)))
    # Comment marks and list numbers that stand alone are no sentences.
    return F.transform(F.filter(F.transform(parts, plain), lambda p: ~p.rlike("^([0-9]{1,2}|[a-z])?$")), known)


def _matched(ids: Column, rules: tuple[LicenseRule, ...]) -> Column:
    """The rules that match a sequence of identifiers, tried in their order; what one has matched is taken out."""
    # Each identifier between bars; unknown sentences stay as empty fields and so part sequences.
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("rest"), F.array().cast("array<string>").alias("hits"))
    table = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit("".join(f"|{s}|" for s in r.sentences)).alias("pattern")) for r in rules])

    def step(state: Column, r: Column) -> Column:
        taken = F.struct(F.replace(state["rest"], r["pattern"], F.lit("||")).alias("rest"), F.array_append(state["hits"], r["rule"]).alias("hits"))
        return F.when(state["rest"].contains(r["pattern"]), taken).otherwise(state)

    return F.aggregate(table, start, step, lambda state: state["hits"])


def license_scan(df: DataFrame, text: str = "text", sentences: dict[str, str] = KNOWN, names: dict[str, str] = KNOWN_NAMES, rules: tuple[LicenseRule, ...] = RULES) -> DataFrame:
    """Adds n_known_sentences, rules (matched, in rule order) and licenses (distinct, sorted)."""
    cuts = {unused(df, f"ids{k}"): cut for k, cut in enumerate((CUT, PARAGRAPH_CUT, CLAUSE_CUT))}
    columns = [unused(df, f"rules{k}") for k in range(len(cuts))]
    # A text without any of these words has no known sentence: it is not cut.
    body = F.when(F.lower(text).rlike("|".join(telling_words(sentences))), F.col(text))
    added = df
    for c, cut in cuts.items():
        added = added.withColumn(c, sentence_ids(body, sentences, names, cut))
    for c, to in zip(cuts, columns, strict=True):
        some = F.exists(c, lambda x: x != "")
        added = added.withColumn(to, F.coalesce(F.when(some, _matched(F.col(c), rules)), F.array().cast("array<string>")))
    # Each sentence as often as the cut that has it most often.
    known = F.filter(F.array_distinct(F.concat(*cuts)), lambda x: x != "")
    often = lambda x: F.greatest(*[F.size(F.filter(c, lambda y: y == x)) for c in cuts])
    # What one cut has is no part of a longer match that only another cut has.
    # Nor is the line of a wrapped text that names its licence.
    part = lambda r, o: set(r.sentences) < set(o.sentences) or (r.sentences[0].startswith("notice-") and o.license == r.license and o.rule != r.rule)
    longer = lambda r: [o.rule for o in rules if part(r, o)]
    table = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.license).alias("license"), F.array(*map(F.lit, longer(r))).cast("array<string>").alias("longer")) for r in rules])
    found = [F.col(c) for c in columns]
    every = F.concat(*found)

    def kept(r: Column) -> Column:
        hit = F.lit(False)
        for f in found:
            hit |= F.array_contains(f, r["rule"]) & F.forall(r["longer"], lambda o: F.array_contains(f, o) | ~F.array_contains(every, o))  # noqa: B023
        return hit

    hits = F.when(F.size(every) > 0, F.filter(table, kept))
    out = {
        "n_known_sentences": F.aggregate(known, F.lit(0), lambda n, x: n + often(x)).cast("long"),
        "rules": F.coalesce(F.transform(hits, lambda r: r["rule"]), F.array().cast("array<string>")),
        "licenses": F.coalesce(F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["license"]))), F.array().cast("array<string>")),
    }
    return added.select(*[f"`{c}`" for c in df.columns if c not in out], *[c.alias(k) for k, c in out.items()])
