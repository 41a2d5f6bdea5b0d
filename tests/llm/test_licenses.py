"""Licence families: notices told from relatives and from prose, against a plain scan of all templates."""

import random

from loomspark.llm import licenses

PROSE = "In and of the river that was there and here on an old road by the sea where it ran for years with no one near".split()
NOTICES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License version 3."), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("GPL-3.0", "distributed under the terms of the GPL, version 3 or later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("Proprietary", "All rights reserved."), ("Proprietary", "Copyright (c) 2021 Jane Doe. All rights reserved."), ("LGPL", "Licensed under the GNU Lesser General Public License."), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND", "Licensed under CC BY-ND 4.0."), ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"), ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."), ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
]
NONE = [
    "The museum notes that all rights reserved by the crown were sold.", "This text is not licensed under the EUPL, Version 1.2.", "She holds a fishing licence of the general public, version and year unknown.",
    "The inn is licensed under the old act to sell ale.", "They spoke of the Eclipse and the public, and of a license to look at it.",
]


def prose(draw, n):
    return " ".join(draw.choice(PROSE) for _ in range(n)) + "."


def test_notices_and_prose(spark):
    draw = random.Random(5)
    texts = [([f], t) for f, t in NOTICES] + [([], t) for t in NONE]
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(100 + i, prose(draw, 60) + "\n\n" + t + "\n\n" + prose(draw, 30)) for i, (_, t) in enumerate(texts)]
    rows += [(1_000 + i, prose(draw, 80)) for i in range(200)]
    got = {r["doc_id"]: [x["family"] for x in r["notices"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i + k: f for i, (f, _) in enumerate(texts) for k in (0, 100)} | {1_000 + i: [] for i in range(200)}


def test_every_template_is_its_own_family():
    """A plain scan: each sentence matches its family best, so that no family hides another."""
    assert len(licenses.TEMPLATES) > 30
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            found = licenses.template_matches(text)
            best = max(found.values())
            assert found[family] == best == 1.0, text
            assert all(m < 1 for f, m in found.items() if f != family), text
