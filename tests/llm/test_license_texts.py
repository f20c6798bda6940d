"""Texts of the licences that the table knows, wrapped as files have them; every sentence and every rule is reached by one of them."""

from __future__ import annotations

import textwrap

import pytest

from storyline.llm import license_scan
from tests.llm.test_license_scan_wrapped import APACHE, BSD3, GPL2, MIT


def wrapped(text, width=72):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZLIB_GRANT = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
ZLIB = f"""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

{ZLIB_GRANT}

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
BSL_GRANT = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software."
FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
NOTICE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
MPL_COPY = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.  See the NOTICE file distributed with this work for additional information.

The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.  You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0"""
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {0} which accompanies this distribution, and is available at https://www.eclipse.org/legal/."
CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
CASES = [
    ("MIT", MIT + "\n" + LIABLE),
    ("MIT", MIT.partition("Permission")[1] + MIT.partition("Permission")[2] + "\n" + LIABLE),
    ("MIT", MIT.partition("Permission")[1] + MIT.partition("Permission")[2].partition("THE SOFTWARE IS")[0]),
    ("MIT", MIT.partition("Permission")[1] + MIT.partition("Permission")[2].partition("The above")[0]),
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + "".join(MIT.partition("Permission")[1:]) + "\n" + LIABLE),
    ("MIT", "MIT License\n\n" + "".join(MIT.partition("Permission")[1:])),
    ("ISC", "ISC License\n\n" + ISC_GRANT + "\n\n" + AS_IS),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("BSD-3-Clause", "Copyright (c) 2015, Somebody\nAll rights reserved.\n\n" + BSD3),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "It is distributed under the 3-clause BSD license."),
    ("BSD-2-Clause", BSD3.partition("3. Neither")[0]),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", APACHE.partition("You may obtain")[0]),
    ("Apache-2.0", ASF),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"),
    ("Apache-2.0", "The ASF licenses this file to you under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("ISC", "ISC License\n\nCopyright (c) 2020 Somebody\n\n" + ISC_GRANT + "\n\n" + AS_IS),
    ("ISC", "Copyright (c) 2020 Somebody\n\n" + ISC_GRANT + "\n\n" + AS_IS),
    ("ISC", ISC_GRANT),
    ("ISC", "The ISC License"),
    ("Zlib", ZLIB),
    ("Zlib", ZLIB_GRANT),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BSL_GRANT),
    ("BSL-1.0", BSL_GRANT),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt.)"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n" + FSF),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + FSF),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n" + FSF),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + FSF),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\n" + FSF),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\n" + FSF),
    *((name, title) for name, title in (("GPL-3.0", "GNU General Public License, version 3"), ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-any", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License, version 3"), ("LGPL", "GNU Lesser General Public License, version 2.1"), ("AGPL-3.0", "GNU Affero General Public License, version 3"))),
    ("GPL-any", GPL2),
    ("LGPL", NOTICE.format("library", ";", "Lesser General", "2.1")),
    ("AGPL-3.0", NOTICE.format("program", ":", "Affero General", "3")),
    ("GPL-3.0", "This program is distributed under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This file is distributed under the terms of the GNU General Public License, version 2 or later."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", MPL + " " + MPL_COPY),
    ("MPL-2.0", MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", EPL.format("2.0").replace("License 2.0", "License v. 2.0")),
    ("EPL-1.0", EPL.format("v1.0")),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License version 2.0."),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("CC-BY-4.0", CC.format("")),
    *((f"CC-BY-{'-'.join(x)}-4.0", CC.format("-" + "-".join({"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}[y] for y in x))) for x in (["NC"], ["SA"], ["ND"], ["NC", "SA"], ["NC", "ND"])),
    ("CC0-1.0", "This work is dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright (c) 2020 Somebody.\nAll rights reserved."),
    ("MIT", "Released under the terms of the MIT License."),
    *((x, f"SPDX-License-Identifier: {x}") for x in license_scan.SPDX),
    ("MIT", "/* License: MIT */"),
    ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"),
    ("", "SPDX-License-Identifier: LicenseRef-Own"),
]
BSD4 = BSD3.replace("3. Neither", """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the organization.

4. Neither""")
ONLY = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License version {2} as published by the Free Software Foundation."
KINDS = (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
FAMILY = lambda x, later: "LGPL" if x.startswith("L") else "GPL-any" if later and x.startswith("G") else x
CASES += [
    ("BSD-4-Clause", BSD4),
    ("BSD-4-Clause", BSD4.partition("4. Neither")[0]),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1."),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 only."),
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("CDDL-1.1", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.1"),
    ("PSF-2.0", 'PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2\n\n1. This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization.'),
    ("PSF-2.0", "1. This LICENSE AGREEMENT is between the Python Software Foundation and the Individual."),
    ("PSF-2.0", "Python Software Foundation License"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\nTERMS AND CONDITIONS FOR COPYING\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("CC-BY-3.0", CC.format("").replace("4.0 International", "3.0 Unported")),
    *((f"CC-BY-{'-'.join(x)}-3.0", CC.format("-" + "-".join({"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}[y] for y in x)).replace("4.0 International", "3.0 Unported")) for x in (["NC"], ["SA"], ["ND"], ["NC", "SA"], ["NC", "ND"])),
    *((FAMILY(x, True), NOTICE.format("program", ";", kind, n)) for x, kind, n in KINDS),
    *((FAMILY(x, False), ONLY.format("program", kind, n)) for x, kind, n in KINDS),
    *((x, f"SPDX-License-Identifier: {x}-or-later") for x, *_ in KINDS),
    ("GPL-any", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL", NOTICE.partition(";")[0].format("library", ";", "Lesser General") + "."),
    ("AGPL-3.0", NOTICE.partition(";")[0].format("program", ":", "Affero General") + "."),
    ("MIT,Apache-2.0", "This crate is licensed under either of Apache License, Version 2.0 or MIT license at your option."),
]
#: An expression of SPDX is on one line.
EXPRESSIONS = [
    ("MIT,Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("MIT,BSD-3-Clause,GPL-2.0", "SPDX-License-Identifier: (GPL-2.0-or-later AND MIT) OR BSD-3-Clause"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */"),
    ("GPL-2.0,LGPL-3.0", "# SPDX-License-Identifier: GPL-2.0-only OR LGPL-3.0-or-later"),
]
TERMS = {
    GPL2: "GPL-2.0-or-later", NOTICE.format("library", ";", "Lesser General", "2.1"): "LGPL-2.1-or-later", ONLY.format("program", "Affero General", "3"): "AGPL-3.0-only", ONLY.format("file", "General", "2"): "GPL-2.0-only",
    "SPDX-License-Identifier: (GPL-2.0-or-later AND MIT) OR LGPL-3.0-or-later": "GPL-2.0-or-later,LGPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0": "", MIT: "", "": "",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, t) for k, (_, text) in enumerate(CASES) for t in (text, wrapped(text), wrapped(text, 40))], "doc_id long, text string")
    out = {}
    for r in license_scan.scan_licenses(spark, rows).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_licences(found):
    wrong = {k: [(r.licenses, r.sentence_ids) for r in found[k]] for k, (want, _) in enumerate(CASES) if {r.licenses for r in found[k]} != {want}}
    assert not wrong, {CASES[k][1][:60]: v for k, v in wrong.items()}


def test_expressions(spark):
    rows = license_scan.scan_licenses(spark, spark.createDataFrame([(k, "words before\n" + t + "\nafter") for k, (_, t) in enumerate(EXPRESSIONS)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in rows} == {k: want for k, (want, _) in enumerate(EXPRESSIONS)}


def test_terms(spark):
    texts = list(TERMS)
    rows = license_scan.scan_licenses(spark, spark.createDataFrame([(k, t if "SPDX" in t else wrapped(t, 50)) for k, t in enumerate(texts)] + [(len(texts), None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.terms for r in rows} == dict(enumerate(TERMS.values())) | {len(texts): ""}


def test_sql_has_expressions(spark):
    """Single lines, which is what the SQL looks up."""
    import duckdb

    lines = ["SPDX-License-Identifier: (GPL-2.0-or-later AND MIT) OR BSD-3-Clause", "SPDX-License-Identifier: GPL-2.0 WITH x AND MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Licensed under CC BY-SA 3.0.", "", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(lines)))
    found = con.sql(license_scan.oracle())
    got = license_scan.scan_licenses(spark, spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).select(*(f"`{c}`" for c in found.columns))
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def test_every_sentence_is_reached(found):
    seen = {i for rows in found.values() for r in rows for i in r.sentence_ids.split(",")}
    assert not set(license_scan.SENTENCES) - seen


def test_every_rule_is_reached(found):
    """By the texts' identifiers: a rule that an earlier one always forestalls would never be."""
    used = set()
    for rows in found.values():
        for r in rows:
            rest = "|" + "||".join(r.sentence_ids.split(",")) + "|"
            for k, (_, rule) in enumerate(license_scan.RULES):
                pattern = "".join(f"|{i}|" for i in rule)
                if pattern in rest:
                    used.add(k)
                    rest = rest.replace(pattern, "|#|")
    assert [license_scan.RULES[k] for k in range(len(license_scan.RULES)) if k not in used] == []
