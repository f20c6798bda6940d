"""Licence recognition by sentences and rules (the method of Ninka, German et al. 2010), by DataFrame operations alone.

A text is cut into sentences, and each is normalised (lower case, letters and digits only, single spaces) and looked up among known licence
sentences. Version numbers, years and names within a sentence are slots: patterns that the normalised form may fill. The identifiers, in
order, with runs of unknown sentences as one gap, form a sequence; ordered rules match in it, the most specific first, and a match uses
up its identifiers. What no rule uses is reported as unmatched licence sentences. One pass over each row, no shuffle.

A known sentence begins and ends where BREAK cuts, and may run across single line breaks and semicolons, so that wrapped texts count; blank
lines and . ! ? end it. Sentences that name a licence may have a subject before and a reference after. The SQL has none of this: it looks
up pieces between two cuts, and n_sentences counts those here too.

What is licensed may also be named by a SPDX identifier, or an expression of several, or a field "License:". "All rights reserved" after a copyright makes a text
proprietary only if it has no licence.

Defined cases: null and empty texts have no sentences and no licence. A very long text is scanned whole. Licences of a text are distinct, in
rule order, joined by a comma; a text with none has an empty string. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Licences that a SPDX identifier, or a field "License:", may name as they are.
SPDX = [
    "MIT", "MIT-0", "ISC", "Zlib", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Artistic-2.0", "Unlicense",
    "BSD-4-Clause", "CDDL-1.0", "CDDL-1.1", "PSF-2.0", "WTFPL", "CC-BY-3.0", "CC-BY-SA-3.0", "CC-BY-NC-3.0", "CC-BY-ND-3.0", "CC-BY-NC-SA-3.0", "CC-BY-NC-ND-3.0",
    "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
]
#: Licences of which a text may say "or later", with the words for each, normalised.
LATER = {"GPL-2.0": ("general", "2"), "GPL-3.0": ("general", "3"), "LGPL-2.1": ("lesser general", "2 1"), "LGPL-3.0": ("lesser general", "3"), "AGPL-3.0": ("affero general", "3")}
#: Parts of Creative Commons licences in words.
PARTS = {"": "", "nc": " noncommercial", "sa": " sharealike", "nd": " noderivatives", "nc sa": " noncommercial sharealike", "nc nd": " noncommercial noderivatives"}
GRANT = "this (program|library|file|software|module) is free software you can redistribute it and or modify it under the terms of the gnu {} public licen[sc]e{} as published by the free software foundation"
#: Sentences of well-known licences, normalised, as regular expressions. The identifier is the key.
SENTENCES = {
    "mit-name": r"(released|licensed|distributed|available) under (the )?(terms of the )?mit( licen[sc]e)?",
    "mit-title": r"(the )?mit licen[sc]e( mit)?",
    "mit-style": r"use of this source code is governed by an? mit style licen[sc]e that can be found in the licen[sc]e file.*",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": r"(the|this) software is provided (by the copyright holders and contributors )?as is .*",
    "liable": r"in no event (shall|will) the (authors?|copyright holders?)( or copyright holders| or contributors)* be (held )?liable .*",
    "isc-title": r"(the )?isc licen[sc]e( isc)?",
    "isc-grant": r"permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted.*",
    "zlib-title": r"(the )?zlib licen[sc]e",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*",
    "zlib-origin": r"(1 )?the origin of this software must not be misrepresented.*",
    "zlib-altered": r"(2 )?altered source versions must be plainly marked as such.*",
    "zlib-notice": r"(3 )?this notice may not be removed or altered from any source distribution",
    "apache2-name": r"(released |licensed |distributed )under the apache licen[sc]e version 2 0( the licen[sc]e)?",
    "apache2-asf": r"the asf licen[sc]es this file to you under the apache licen[sc]e version 2 0( the licen[sc]e)?",
    "apache2-title": r"apache licen[sc]e( version 2 0)?( january 2004)?",
    "apache2-comply": r"you may not use this (file|work) except in compliance with the licen[sc]e",
    "apache2-copy": r"you may obtain a copy of the licen[sc]e at.*",
    "asf-agree": r"licensed to the apache software foundation( asf)? under one or more contributor licen[sc]e agreements",
    "gpl3-name": r"(this (work|program|file|software) is )?(released|licensed|distributed) under the gnu general public licen[sc]e version 3( or later)?",
    "gpl2-name": r"(this (work|program|file|software) is )?(released|licensed|distributed) under the gnu general public licen[sc]e version 2( or later)?",
    "gpl3-title": r"gnu general public licen[sc]e version 3( 29 june 2007)?",
    "gpl2-title": r"gnu general public licen[sc]e version 2( june 1991)?",
    "gpl-title": r"gnu general public licen[sc]e( version 1)?",
    **{f"{x.lower()}-grant-later": GRANT.format(kind, "") + f" either version {n} of the licen[sc]e or( at your option)? any later version.*" for x, (kind, n) in LATER.items()},
    **{f"{x.lower()}-grant-only": GRANT.format(kind, f" version {n}( only)?") + ".*" for x, (kind, n) in LATER.items()},
    "gpl-free": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation.*",
    "lgpl-name": r"(this (work|program|file|software|library) is )?(released|licensed|distributed) under the gnu lesser general public licen[sc]e version (2 1|3)( or later)?",
    "lgpl3-title": r"gnu lesser general public licen[sc]e version 3( 29 june 2007)?",
    "lgpl21-title": r"gnu lesser general public licen[sc]e version 2 1( february 1999)?",
    "lgpl-free": r"this (library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation.*",
    "agpl-name": r"(this (work|program|file|software) is )?(released|licensed|distributed) under the gnu affero general public licen[sc]e version 3( or later)?",
    "agpl3-title": r"gnu affero general public licen[sc]e version 3( 19 november 2007)?",
    "agpl-free": r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation.*",
    "fsf-copies": r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",
    "bsd-source": r"(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer.*",
    "bsd-advertise": r"(3 )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*",
    "bsd-endorse": r"(3 )?neither the name of .* may be used to endorse or promote products derived from this software.*",
    "bsd-name": r"(released|licensed|distributed) under (the|a) (2 clause |3 clause |new |simplified )?bsd licen[sc]e",
    "bsd-style": r"use of this source code is governed by a bsd style licen[sc]e that can be found in the licen[sc]e file.*",
    "mpl2-name": r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0",
    "mpl2-copy": r"if a copy of the mpl was not distributed with this file you can obtain one at.*",
    "mpl2-title": r"mozilla public licen[sc]e version 2 0",
    "mpl11-name": r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1( the licen[sc]e)?",
    "mpl11-title": r"mozilla public licen[sc]e version 1 1",
    "cddl-header": r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e.*",
    "cddl-title": r"common development and distribution licen[sc]e( cddl)? version 1 0",
    "cddl11-title": r"common development and distribution licen[sc]e( cddl)? version 1 1",
    "psf-title": r"python software foundation licen[sc]e( version 2)?",
    "psf-grant": r"(1 )?this licen[sc]e agreement is between the python software foundation.*",
    "wtfpl-title": r"do what the fuck you want to public licen[sc]e( version 2( december 2004)?)?",
    "wtfpl-grant": r"(0 )?you just do what the fuck you want to",
    "epl2-name": r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v( )?2 0.*",
    "epl1-name": r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v( )?1 0.*",
    "epl2-title": r"eclipse public licen[sc]e v( )?2 0",
    "bsl-name": r"distributed under the boost software licen[sc]e version 1 0",
    "bsl-title": r"boost software licen[sc]e version 1 0( august 17th 2003)?",
    "bsl-grant": r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[sc]e.*",
    "artistic2-name": r"(this (program|library|software|module) is )?(free software you can redistribute it and or modify it|released|licensed|distributed) under the terms of the artistic licen[sc]e( version)? 2 0",
    "artistic2-title": r"(the )?artistic licen[sc]e 2 0",
    "cc-by-nc-sa4-name": r"((this (work|text) is )?licensed under )?(cc by nc sa 4 0|a?( )?creative commons attribution noncommercial sharealike 4 0( international)?( public)?( licen[sc]e)?)",
    "cc-by-nc-nd4-name": r"((this (work|text) is )?licensed under )?(cc by nc nd 4 0|a?( )?creative commons attribution noncommercial noderivatives 4 0( international)?( public)?( licen[sc]e)?)",
    "cc-by-nc4-name": r"((this (work|text) is )?licensed under )?(cc by nc 4 0|a?( )?creative commons attribution noncommercial 4 0( international)?( public)?( licen[sc]e)?)",
    "cc-by-nd4-name": r"((this (work|text) is )?licensed under )?(cc by nd 4 0|a?( )?creative commons attribution noderivatives 4 0( international)?( public)?( licen[sc]e)?)",
    "cc-by-sa4-name": r"((this (work|text) is )?licensed under )?(cc by sa 4 0|a?( )?creative commons attribution sharealike 4 0( international)?( public)?( licen[sc]e)?)",
    "cc-by4-name": r"((this (work|text) is )?licensed under )?(cc by 4 0|a?( )?creative commons attribution 4 0( international)?( public)?( licen[sc]e)?)",
    **{f"cc-by{'-' * bool(k)}{k.replace(' ', '-')}3-name": rf"((this (work|text) is )?licensed under )?(cc by{' ' * bool(k)}{k} 3 0|a?( )?creative commons attribution{words} 3 0( unported| international)?( public)?( licen[sc]e)?)" for k, words in PARTS.items()},
    "cc0-name": r"((this (work|text) is )?(licensed|dedicated) (under|to) )?(cc0( 1 0)?( universal)?|the public domain)",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "unlicense-grant": r"anyone is free to copy modify publish use compile sell or distribute this software.*",
    "rights": r"all rights reserved",
    "copyright": r"copyright( c)?( [0-9]{4}.*)",
} | {f"spdx-{x}-later": r"(spdx licen[sc]e identifier|licen[sc]e) " + re.sub("[^a-z0-9]+", " ", x.lower()) + " or later" for x in LATER} | {f"spdx-{x}": r"(spdx licen[sc]e identifier|licen[sc]e) " + re.sub("[^a-z0-9]+", " ", x.lower()) + "( only| or later)?" for x in SPDX} | {"spdx": r"spdx licen[sc]e identifier .*"}
#: Rules in order; each is a licence and the identifiers that must follow each other, gaps of unknown text apart.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is", "liable")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("asf-agree", "apache2-asf", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-name", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-name", "apache2-comply")),
    ("ISC", ("isc-title", "isc-grant", "as-is")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("as-is", "liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("GPL-3.0", ("gpl3-title", "fsf-copies")),
    ("GPL-2.0", ("gpl2-title", "fsf-copies")),
    ("LGPL", ("lgpl3-title", "fsf-copies")),
    ("LGPL", ("lgpl21-title", "fsf-copies")),
    ("AGPL-3.0", ("agpl3-title", "fsf-copies")),
    ("MPL-2.0", ("mpl2-name", "mpl2-copy")),
    ("Unlicense", ("unlicense", "unlicense-grant")),
    ("MPL-1.1", ("mpl11-name", "apache2-comply", "apache2-copy")),
    ("MPL-1.1", ("mpl11-name",)),
    ("CDDL-1.0", ("cddl-header", "apache2-comply")),
    ("CDDL-1.0", ("cddl-header",)),
    ("PSF-2.0", ("psf-title", "psf-grant")),
    ("PSF-2.0", ("psf-grant",)),
    ("WTFPL", ("wtfpl-title", "wtfpl-title", "wtfpl-grant")),
    ("WTFPL", ("wtfpl-title", "wtfpl-grant")),
    *(("GPL-any" if x.startswith("GPL") else "LGPL" if x.startswith("LGPL") else x, (f"{x.lower()}-grant-later",)) for x in LATER),
    *(("LGPL" if x.startswith("LGPL") else x, (f"{x.lower()}-grant-only",)) for x in LATER),
    ("GPL-any", ("gpl-free",)),
    ("LGPL", ("lgpl-free",)),
    ("AGPL-3.0", ("agpl-free",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-style",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache2-name",)),
    ("Apache-2.0", ("apache2-asf",)),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-2.0", ("gpl2-name",)),
    ("LGPL", ("lgpl-name",)),
    ("AGPL-3.0", ("agpl-name",)),
    ("BSD", ("bsd-name",)),
    ("BSD", ("bsd-style",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("EPL-2.0", ("epl2-name",)),
    ("EPL-1.0", ("epl1-name",)),
    ("BSL-1.0", ("bsl-name",)),
    ("Artistic-2.0", ("artistic2-name",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa4-name",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd4-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-name",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-name",)),
    ("CC-BY-4.0", ("cc-by4-name",)),
    *((f"CC-BY{'-' * bool(k)}{k.replace(' ', '-').upper()}-3.0", (f"cc-by{'-' * bool(k)}{k.replace(' ', '-')}3-name",)) for k in PARTS),
    ("CC0-1.0", ("cc0-name",)),
    ("Unlicense", ("unlicense",)),
    *((x, (f"spdx-{x}-later",)) for x in LATER),
    *((x, (f"spdx-{x}",)) for x in SPDX),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-title",)),
    ("Zlib", ("zlib-title",)),
    ("Apache-2.0", ("apache2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-any", ("gpl-title",)),
    ("LGPL", ("lgpl3-title",)),
    ("LGPL", ("lgpl21-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-1.1", ("mpl11-title",)),
    ("CDDL-1.0", ("cddl-title",)),
    ("CDDL-1.1", ("cddl11-title",)),
    ("PSF-2.0", ("psf-title",)),
    ("WTFPL", ("wtfpl-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("BSL-1.0", ("bsl-title",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("proprietary", ("copyright", "rights")),
]
#: What a text says of a licence's versions, by identifier.
TERMS = {f"{x.lower()}-grant-{t}": f"{x}-{'or-later' if t == 'later' else 'only'}" for x in LATER for t in ("later", "only")} | {f"spdx-{x}-later": f"{x}-or-later" for x in LATER}
#: Sentences that name several licences. Expressions of SPDX are cut at their operators; one that leaves a choice of two is as both apart.
EXPRESSION, CHOICE = "spdx licen[sc]e identifier ", "licensed under (the terms of )?either (of )?(the )?apache licen[sc]e version 2 0 or (the )?mit( licen[sc]e)?( at your option)?"
CHOICES = ["licensed under the apache license version 2 0", "licensed under the mit license"]
#: Ends of sentences: line breaks; and . ! ? ; before white space, a quote or bracket or the end.
BREAK = r"[\n\r\x0b\x0c]+|[.!?;]+[\x22\x27)\]]*[ \t]+|[.!?;]+[\x22\x27)\]]*$"
#: Within a lowered text, H ends every sentence and S ends pieces only. A cut after "v" is of the second kind, as in "v. 2.0".
HARD = r"\n[ \t*#/]*(?=\n)|[\x0b\x0c]|(?<!\bv)[.!?]+[\x22\x27)\]]*(?=[ \t\n\x0b\x0c]|$)"
SOFT = r"\n|(?:;|(?<=\bv)[.!?])[\x22\x27)\]]*(?=[ \t\n]|$)"
#: Every known sentence has one of these; texts without any are unknown at once.
HINT = r"licen[sc]|permission|software|copyright|redistribut|bsd|rights|cc[^a-z0-9]+by|cc0|creative[^a-z0-9]+commons|public[^a-z0-9]+domain|endorse"
#: Before a sentence that names a licence: what is licensed, unless it is denied or a condition. After it: where to read more.
WORDS = r"(?:[a-z0-9]+ ){1,8}?"
SUBJECT = r"(?!(?:if|when|where|whether|unless|until|once|because|suppose|no|not|none|nothing|neither) )" + WORDS + r"(?:is|are) (?:also |hereby )?(?=released|licensed|distributed|available|dedicated)"
TAIL = r" (?:see|as|in the|which|whose|a copy of|the full|unless|https?|or( at your option)? any later version|for (?:more |further )?(?:details|information))(?: .*)?"
NOT_WORD = r"[^a-z0-9]+"


def variants() -> dict[str, str]:
    """SENTENCES with what sentences in running text may have besides."""
    out = {}
    for name, pattern in SENTENCES.items():
        if name.endswith("-name"):
            pattern = pattern.replace(" under the ", " under (the terms of )?the ").replace("a?( )?creative", "((a|the) )?creative")
            pattern = f"(?:{SUBJECT})?(?:{pattern})(?:{TAIL})?"
        out[name] = pattern
    return out


def across(pattern: str) -> str:
    """A pattern of normalised sentences as one that runs across S. Where any rest of a sentence will do, it ends with its piece, and a
    subject's words are of one piece, or they could take in what is before."""
    head, rest, end = pattern.rpartition(".*")
    if rest and end.strip(")?") == "":
        pattern = head + ("[a-z0-9]" if head.endswith(" ") else "") + "[^HS]*" + end
    return pattern.replace(".*", "[^H]*?").replace(" ", "[ S]+").replace(WORDS.replace(" ", "[ S]+"), WORDS)


VARIANTS = variants()
DUAL = f"({SUBJECT})?{CHOICE}"
KNOWN = "(?<=[HS]|[HS] )(?:" + "|".join(across(p) for p in [*VARIANTS.values(), DUAL]) + ")(?= ?[HS])"


def marked(text: Column) -> Column:
    """A text, lowered and normalised, with its cuts."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), HARD, "H"), SOFT, "S")
    return F.regexp_replace(F.concat(F.lit("H"), cut, F.lit("H")), "[^a-z0-9HS]+", " ")


def identifier(sentence: Column) -> Column:
    """The known identifier of a normalised sentence, "-" for an unknown one."""
    known = F.lit("-")
    for name, pattern in reversed(VARIANTS.items()):
        known = F.when(sentence.rlike(f"^(?:{pattern})$"), name).otherwise(known)
    return known


def simple(sentence: Column) -> Column:
    """A normalised sentence as the sentences that name one licence each: "A OR B" is two, and what follows WITH is left out."""
    parts = F.split(F.regexp_replace(F.regexp_replace(sentence, f"^{EXPRESSION}", ""), " or later", "+later"), " (?:or|and) ", -1)
    parts = F.transform(parts, lambda p: F.concat(F.lit("spdx license identifier "), F.regexp_replace(F.replace(p, F.lit("+later"), F.lit(" or later")), " with .*", "")))
    return F.when(sentence.rlike(f"^{EXPRESSION}"), parts).when(sentence.rlike(f"^{DUAL}$"), F.array(*map(F.lit, CHOICES))).otherwise(F.array(sentence))


def identifiers(text: Column) -> Column:
    """The text's identifiers in order, unknown sentences left out."""
    found = F.regexp_extract_all(marked(text), F.lit(KNOWN), F.lit(0))
    found = F.flatten(F.transform(found, lambda s: simple(F.trim(F.regexp_replace(s, "[ S]+", " ")))))
    found = F.transform(found, identifier)
    return F.when(F.lower(text).rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def sequence(ids: Column) -> Column:
    """Identifiers as one string, each between bars."""
    return F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))


def apply_rules(documents: DataFrame, ids: str = "ids") -> DataFrame:
    """Adds licenses (comma-joined) and rest (identifiers that no rule used) to a table with identifier arrays. A text with a licence isn't
    reported as proprietary besides."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in rule)).alias("ids")) for name, rule in RULES))
    start = F.struct(sequence(F.col(ids)).alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(s: Column, rule: Column) -> Column:
        hit = F.contains(s["rest"], rule["ids"])
        return F.struct(F.when(hit, F.replace(s["rest"], rule["ids"], F.lit("|#|"))).otherwise(s["rest"]).alias("rest"), F.when(hit, F.array_append(s["names"], rule["name"])).otherwise(s["names"]).alias("names"))

    out = documents.withColumn("applied", F.when(F.size(ids) > 0, F.aggregate(rules, start, apply)))
    order = F.array(*(F.lit(name) for name in dict.fromkeys(name for name, _ in RULES)))
    names = F.filter(order, lambda x: F.array_contains(F.coalesce("applied.names", F.array().cast("array<string>")), x))
    licenses = F.array_join(F.when(F.size(names) > 1, F.array_remove(names, "proprietary")).otherwise(names), ",")
    return out.withColumn("licenses", licenses).withColumn("rest", F.coalesce("applied.rest", F.lit(""))).drop("applied")


def term(identifier: Column) -> Column:
    """What an identifier says of versions, null for most."""
    out = F.lit(None).cast("string")
    for name, said in TERMS.items():
        out = F.when(identifier == name, said).otherwise(out)
    return out


def scan_licenses(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per document: its sentences, those known, the identifier sequence, the licences, whether known sentences are left over, and what is said
    of versions: "-or-later" or "-only"."""
    text = text_of("text")
    rows = documents.select("doc_id", F.size(F.filter(F.split(text, BREAK, -1), lambda s: s.rlike("[A-Za-z0-9]"))).cast("long").alias("n_sentences"), identifiers(text).alias("ids"))
    out = apply_rules(rows)
    unmatched = F.size(F.filter(F.split("rest", "\\|", -1), lambda s: (s != "") & (s != "#"))).cast("long")
    said = F.transform("ids", term)
    terms = F.array_join(F.filter(F.array(*map(F.lit, dict.fromkeys(TERMS.values()))), lambda t: F.coalesce(F.array_contains(said, t), F.lit(False))), ",")
    return out.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), "licenses", unmatched.alias("n_unmatched"), terms.alias("terms"))


def oracle() -> str:
    """The same scan as DuckDB SQL, from the same fixed values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = " ".join(f"WHEN regexp_full_match(s, {quoted(p)}) THEN '{n}'" for n, p in SENTENCES.items())
    steps, last = [], "r0"
    for k, (_, rule) in enumerate(RULES):
        pattern = quoted("".join("\\|" + i.replace(".", "\\.") + "\\|" for i in rule))
        steps.append(f"r{k + 1} AS (SELECT * EXCLUDE (rest), regexp_matches(rest, {pattern}) AS m{k}, regexp_replace(rest, {pattern}, '|#|', 'g') AS rest FROM {last})")
        last = f"r{k + 1}"
    terms = " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in TERMS.items())
    names = ", ".join(f"CASE WHEN m{k} THEN '{n}' END" for k, (n, _) in enumerate(RULES))
    order = "[" + ", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in RULES)) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(t, {quoted(BREAK)}), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) AS BIGINT) AS n_sentences,
  list_transform(regexp_split_to_array(lower(t), {quoted(BREAK)}), lambda x: trim(regexp_replace(x, '{NOT_WORD}', ' ', 'g'))) AS parts FROM d),
e AS (SELECT doc_id, n_sentences, flatten(list_transform(parts, lambda s: CASE WHEN regexp_matches(s, '^{EXPRESSION}')
    THEN list_transform(regexp_split_to_array(replace(regexp_replace(s, '^{EXPRESSION}', ''), ' or later', '+later'), ' (or|and) '), lambda p: 'spdx license identifier ' || regexp_replace(replace(p, '+later', ' or later'), ' with .*', ''))
    WHEN regexp_full_match(s, {quoted(CHOICE)}) THEN {CHOICES} ELSE [s] END)) AS parts FROM s),
i AS (SELECT doc_id, n_sentences, list_filter(list_transform(parts, lambda s: CASE {known} ELSE '-' END), lambda x: x <> '-') AS ids FROM e),
r0 AS (SELECT doc_id, n_sentences, ids, CASE WHEN len(ids) > 0 THEN '|' || array_to_string(ids, '||') || '|' ELSE '' END AS rest FROM i),
{", ".join(steps)},
f AS (SELECT *, [{names}] AS hit FROM {last})
SELECT doc_id, n_sentences, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter({order}, lambda x: list_contains(hit, x) AND (x <> 'proprietary' OR len(list_filter(hit, lambda y: y IS NOT NULL AND y <> 'proprietary')) = 0)), ',') AS licenses,
  CAST(len(list_filter(string_split(rest, '|'), lambda x: x <> '' AND x <> '#')) AS BIGINT) AS n_unmatched,
  array_to_string(list_filter([{", ".join(f"'{t}'" for t in dict.fromkeys(TERMS.values()))}], lambda t: list_contains(list_transform(ids, lambda x: CASE x {terms} END), t)), ',') AS terms FROM f
"""
