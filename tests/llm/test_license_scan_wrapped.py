"""Licence texts as files and headers have them: wrapped, commented, with subjects and tails."""

from __future__ import annotations

import textwrap

import pytest

from storyline.llm import license_scan

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
TEXTS = [("MIT", MIT), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("Apache-2.0", APACHE), ("GPL-any", GPL2)]
CASES = [(name, change(text)) for name, text in TEXTS for change in (
    lambda t: t,
    lambda t: t.replace("\n", "\r\n"),
    lambda t: textwrap.indent(t, " * ", lambda line: True),
    lambda t: textwrap.indent(t, "# ", lambda line: True),
    lambda t: "\n\n".join(textwrap.fill(p, 40) for p in t.split("\n\n")),
    lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
    lambda t: "Some words before\n" + t + "some words after",
)]
CASES += [
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "The code of this project is licensed\nunder the MIT License - see the LICENSE file for details."),
    ("MIT", "Widgets are released under the terms of the\nMIT licence."),
    ("GPL-3.0", "It is distributed under the terms of the GNU General Public License, version 3, or (at your option) any later version."),
    ("CC-BY-4.0", "The text is licensed under a Creative\nCommons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
    ("", "This project is not licensed under the MIT License."),
    ("", "If your project is licensed under the MIT License, write to us."),
    ("", "Permission is hereby granted.\n\nFree of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("", "no cuts at all " * 50_000 + "; " * 50_000 + "\n" * 50_000 + "software"),
    ("", "软件\n" * 50_000 + "." * 2_000 + "software"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan_licenses(spark, rows).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_licence(found, k):
    assert found[k].licenses == CASES[k][0], (CASES[k][1][:200], found[k])
