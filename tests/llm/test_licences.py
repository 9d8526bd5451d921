import re

import pytest

from skeinmatch.llm import license_tfidf

SCHEMA = "id bigint, path string, text string, is_license_file boolean"
GPL = """{c} This program is free software; you can redistribute it and/or modify
{c} it under the terms of the GNU General Public License as published by
{c} the Free Software Foundation; either version {v} of the License, or
{c} (at your option) any later version.
"""
#: Wordings that no table of the fixture holds.
STATED = [
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "// SPDX-License-Identifier: MIT\nint main() { return 0; }"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport os"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("GPL-3.0", "# Copyright 2020 A. Person\n#\n" + GPL.format(c="#", v=3) + "import os\nprint(os.getcwd())\n"),
    ("GPL-2.0", "/*\n * A tool.\n" + GPL.format(c=" *", v=2) + " */\nint x;"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n"),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nvar a = 1;"),
    ("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n'),
    ("BSD-2-Clause", "Distributed under the\nSimplified BSD License."),
    ("ISC", "License: ISC License"),
    (None, "Distributed under the Zlib License."),
    (None, "We read the license of the GNU people and the general public was there."),
    (None, "Er kam mit.\nMit\nDas Haus mit dem Garten."),
    (None, "Show w, show c.\nShow\nshow show\nA transaction is a transaction."),
    (None, "Copies of the GNU General Public License are to be had."),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for _, t in STATED] + [p.read_text() for p in sorted(license_tfidf.TEXTS.glob("*.txt"))]
    rows = [(i, f"d{i}/f", t, False) for i, t in enumerate(texts)]
    got = license_tfidf.licenses(spark.createDataFrame(rows, SCHEMA))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return {r["id"]: r["license"] for r in got.collect()}


def test_other_wordings(found):
    assert [found[i] for i in range(len(STATED))] == [k for k, _ in STATED]


def test_whole_licence_texts(found):
    names = [p.stem.removesuffix("-header") for p in sorted(license_tfidf.TEXTS.glob("*.txt"))]
    assert [found[len(STATED) + i] for i in range(len(names))] == names


@pytest.mark.parametrize("templates", [license_tfidf.wordings(), *map(license_tfidf.passages, license_tfidf.PASSAGE_TERMS)])
def test_bounds_lose_nothing(templates):
    rows, _, _, needed = license_tfidf.template_weights(templates)
    known, least = license_tfidf.vocabulary(templates)
    masses = {}
    for k, w, x in rows:
        masses.setdefault(k, {})[w] = x * x
    for held in masses.values():
        assert sum(x for w, x in held.items() if w not in needed) < license_tfidf.THRESHOLD**2
        assert sum(sorted(held.values(), reverse=True)[: least - 1]) < license_tfidf.THRESHOLD**2
    pattern = re.compile(license_tfidf.holds(known))
    assert all(pattern.search(f"x {w} zz").group() == w for w in known if w != "x") and not pattern.search("zzzq")
