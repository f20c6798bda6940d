from __future__ import annotations

import pytest

from storyline.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
CASES = [
    ("Released under the MIT License.", "mit-name", "MIT", 0),
    ("text before. Licensed under the Apache License, Version 2.0. and after", "apache2-name", "Apache-2.0", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl3-name", "GPL-3.0", 0),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc4-name", "CC-BY-NC-4.0", 0),
    ("The MIT License (MIT)\n" + MIT, "mit-title,mit-grant,mit-notice,as-is", "MIT", 0),
    ("MIT License\nsome unknown line\n" + MIT, "mit-title,mit-grant,mit-notice,as-is", "MIT", 0),
    ("Copyright (c) 2020 Somebody\nAll rights reserved.", "copyright,rights", "proprietary", 0),
    ("All rights reserved.", "rights", "", 1),
    ("Released under the MIT License.\nLicensed under CC BY 4.0.\nReleased under the MIT License.", "mit-name,cc-by4-name,mit-name", "MIT,CC-BY-4.0", 0),
    ("I have a driving licence and permission to drive.", "", "", 0),
    ("", "", "", 0),
    (None, "", "", 0),
    ("word " * 200_000 + "\nReleased under the MIT License.", "mit-name", "MIT", 0),
]


def test_cases(spark, documents):
    rows = [(k, c[0]) for k, c in enumerate(CASES)] + [(None, CASES[0][0]), (0, CASES[0][0])]
    got = license_scan.scan_licenses(spark, documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.sentence_ids, r.licenses, r.n_unmatched) == CASES[r.doc_id or 0][1:]


def test_empty(spark, documents):
    assert license_scan.scan_licenses(spark, documents([(1, "x")]).limit(0)).count() == 0


def test_only_columns(spark, documents):
    plan = license_scan.scan_licenses(spark, documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", sorted({i for _, rule in license_scan.RULES for i in rule}))
def test_rules_use_known_sentences(name):
    assert name in license_scan.SENTENCES
