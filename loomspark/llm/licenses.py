"""License notices in documents by a trained paragraph classifier (operator 9)."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers
from .words import mix, word_hashes

#: What public licences are called in notices, by family, and sentences of their own headers and texts.
NAMES = {
    "MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"], "Apache-1.1": ["Apache License, Version 1.1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPL, version 2", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPL, version 3", "GPLv3"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL"], "AGPL-3.0": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3"],
    "BSD": ["BSD 3-Clause License", "BSD license", "3-clause BSD license"], "BSD-2": ["BSD 2-Clause License", "2-clause BSD license"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"], "MPL-1.1": ["Mozilla Public License Version 1.1"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0"], "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License 2.0"], "ISC": ["ISC License"], "Zlib": ["zlib License", "zlib/libpng license"],
    "BSL-1.0": ["Boost Software License, Version 1.0"], "MS-PL": ["Microsoft Public License"], "MS-RL": ["Microsoft Reciprocal License"], "Artistic-2.0": ["Artistic License 2.0", "Artistic License, version 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"], "EUPL-1.2": ["European Union Public Licence, version 1.2", "EUPL, Version 1.2", "EUPL v1.2"], "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License v1.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License"], "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"], "AFL-3.0": ["Academic Free License version 3.0"], "OSL-3.0": ["Open Software License version 3.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"], "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal public domain dedication"], "Unlicense": ["Unlicense"], "WTFPL": ["WTFPL"], "PostgreSQL": ["PostgreSQL License"], "Python-2.0": ["Python Software Foundation License Version 2"], "CeCILL-2.1": ["CeCILL FREE SOFTWARE LICENSE AGREEMENT Version 2.1", "CeCILL license version 2.1"], "Proprietary": [],
}
HEADERS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "Apache-1.1": ["The Apache Software License, Version 1.1"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"], "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "EPL-1.0": ["Eclipse Public License - v 1.0", "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"], "EPL-2.0": ["Eclipse Public License - v 2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "MS-PL": ["Microsoft Public License (Ms-PL)"], "MS-RL": ["Microsoft Reciprocal License (Ms-RL)"], "Artistic-2.0": ["The Artistic License 2.0"], "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "ODbL-1.0": ["This database is made available under the Open Database License"], "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3"],
    "CC-BY": ["Text is available under CC BY 4.0."], "CC-BY-NC": ["Available under CC BY-NC 4.0 for noncommercial use."], "CC-BY-SA": ["Text is available under CC BY-SA 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0."], "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
    "Proprietary": ["All rights reserved.", "Copyright (c) 2020 Example Inc. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: How notices speak of a licence by its name, and its id for machines.
PHRASES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "distributed under the terms of the {}", "Licensed under {}.", "SPDX-License-Identifier: {}")
#: Words of licences' names that tell none from another.
PLAIN_WORDS = {"license", "licence", "public", "general", "version", "v", "the", "of", "software", "and", "international", "agreement", "gnu", "or", "domain", "dedication", "creative", "commons", "universal"}
#: Texts that speak of licences and rights, and grant nothing.
SIMILAR = [
    "The museum notes that all rights reserved by the crown were sold.", "All rights reserved to the tenants were listed in the lease.", "She was granted a driving license under the new terms.", "Every angler must hold a public fishing licence, version and year printed on it.",
    "The bar is licensed under the local act to serve until midnight.", "The film was released under the title of the novel.", "The software was distributed to the general public free of charge.", "Permission to build is hereby granted by the city to any person who owns the lot.",
    "This work is based on the general theory and its terms.", "He wrote about the history of the MIT campus and its open source community.", "The commons were open to all, and the public used them without a license.", "Any reproduction of the portrait in the public gallery must be approved.",
]
#: Ids where they are longer than the family's name.
IDS = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only", "LGPL": "LGPL-3.0-only", "BSD": "BSD-3-Clause", "BSD-2": "BSD-2-Clause", "CC0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3-only", "Proprietary": "LicenseRef-Proprietary"} | {f: f"{f}-4.0" for f in NAMES if f.startswith("CC-")}
TEMPLATES = {f: [p.format(n) for n in names for p in PHRASES[:5]] + [PHRASES[5].format(IDS.get(f, f))] + HEADERS.get(f, []) for f, names in NAMES.items()}
#: The words of each family's names that tell it from others; those of a template must be in a notice that it matches.
OWN_WORDS = {f: {w for n in names for w in re.findall(r"[a-z]+", n.lower())} - PLAIN_WORDS for f, names in NAMES.items()}
FAMILIES = ["unknown", *TEMPLATES]
#: Hashed word unigrams and bigrams; stretches of the corpus that stand for the unknown class, at most, and their length in characters.
BITS, NEGATIVES, STRETCH, EPOCHS, RATE, DECAY = 15, 3_000, 400, 60, 2.0, 1e-4
#: Least variants of each template, and of each family's templates together; every fifth is held out for calibration.
VARIANTS, OF_FAMILY = 3, 60
#: Least calibrated probability that a paragraph is a notice at all, and least share of a template's word pairs
#: that it must hold.
SURE, MATCH = 0.5, 0.7
#: "All rights reserved" is a notice where its sentence or line ends; in "all rights reserved by the crown" it is none.
RESERVED = re.compile(r"\ball\s+rights\s+reserved\s*(?:[.!;:)\]*/#\n\r-]|$)", re.I)
#: Words by which a notice is denied.
DENIED = re.compile(r"\b(?:not|never|no longer|neither)\s+(?:being\s+|be\s+)?(?:licensed|released|available|distributed|dedicated|covered)\b", re.I)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each word and word pair, number of them in each paragraph)."""
    words, first, _, _ = word_hashes(data, offsets)
    count = np.diff(first)
    mask = np.uint64((1 << BITS) - 1)
    single = mix(words + np.uint64(1)) & mask
    pair = np.zeros(len(words), np.uint64)
    pair[1:] = mix(words[1:] ^ mix(words[:-1] + np.uint64(3))) & mask
    both = np.stack([single, pair], axis=1)
    keep = np.ones(both.shape, bool)
    keep[first[:-1][count > 0], 1] = False
    return both[keep].astype(np.int64), np.maximum(2 * count - 1, 0)


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pa.array([clean(t) for t in texts], pa.string()))


def clean(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else " " for c in text)


class Classifier:
    """Multinomial logistic regression over hashed word n-grams, with a temperature fitted on held-out texts.

    Texts of a family are variants of its templates with words left out, some within words of the
    corpus; of the unknown class, stretches of the corpus and denied templates. Every fifth is held out.
    """

    def __init__(self, negatives: list[str], seed: int = 9) -> None:
        draw = np.random.default_rng(seed)
        texts, labels = list(negatives), [0] * len(negatives)

        def around(words: list[str]) -> list[str]:
            if not negatives or draw.random() < 0.5:
                return words
            own = clean(negatives[draw.integers(len(negatives))]).split()
            return own[: draw.integers(9)] + words + own[-1 - draw.integers(9) :]

        for i, family in enumerate(FAMILIES[1:], 1):
            for template in TEMPLATES[family]:
                words = clean(template).split()
                for variant in range(max(VARIANTS, OF_FAMILY // len(TEMPLATES[family]))):
                    keep = [w for w in words if variant == 0 or draw.random() > 0.12] or words
                    texts.append(" ".join(keep if variant == 0 else around(keep)))
                    labels.append(i)
                for verb in ("licensed", "released", "available"):
                    if verb in words or verb.capitalize() in words:
                        texts.append(" ".join("not " + w.lower() if w.lower() == verb else w for w in around(words)))
                        labels.append(0)
        for text in SIMILAR:
            words = clean(text).split()
            for variant in range(VARIANTS):
                texts.append(" ".join(words if variant == 0 else around([w for w in words if draw.random() > 0.12])))
                labels.append(0)
        x, n = grams(*_buffers(texts))
        y, held = np.array(labels), np.arange(len(texts)) % 5 == 4
        row = np.repeat(np.arange(len(texts)), n)
        value = (1 / np.sqrt(np.maximum(n, 1)))[row].astype(np.float32)
        # only grams of notices and of what is like them get weights: of the corpus' own there are many, and the bias stands for them
        some = np.zeros(1 << BITS, bool)
        some[x[row >= len(negatives)]] = True
        x, row, value = (c[some[x]] for c in (x, row, value))
        known, x = np.unique(x, return_inverse=True)
        by = np.argsort(x, kind="stable")
        at, row_by, value_by = np.searchsorted(x[by], np.arange(len(known))), row[by], value[by][:, None]
        self.bias = np.zeros(len(FAMILIES), np.float32)
        w, speed = np.zeros((len(known), len(FAMILIES)), np.float32), np.full(len(known), 1e-8, np.float32)
        fitted, truth = (~held / max(1, (~held).sum())).astype(np.float32), np.eye(len(FAMILIES), dtype=np.float32)[y]
        begin, full = np.searchsorted(row, np.arange(len(texts))), np.bincount(row, minlength=len(texts)) > 0

        def margins() -> np.ndarray:
            out = np.zeros((len(texts), len(FAMILIES)), np.float32)
            if len(row):
                out[full] = np.add.reduceat(w[x] * value[:, None], begin[full], axis=0)
            return out + self.bias

        for _ in range(EPOCHS):
            error = (self._softmax(margins()) - truth) * fitted[:, None]
            gradient = np.add.reduceat(error[row_by] * value_by, at, axis=0)
            speed += (gradient**2).sum(axis=1)
            w -= RATE * (gradient / np.sqrt(speed)[:, None] * 0.1 + DECAY * w)
            self.bias -= RATE * error.sum(axis=0)
        last = margins()[held]
        losses = [(-np.log(self._softmax(last * s)[np.arange(held.sum()), y[held]] + 1e-12).mean(), s) for s in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)] if held.any() else [(0, 1.0)]
        self.loss, self.sharpness = min(losses)
        self.w = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
        self.w[known] = w

    @staticmethod
    def _softmax(m):
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, n = grams(data, offsets)
        out = np.zeros((len(n), len(FAMILIES)))
        some = np.flatnonzero(n > 0)
        if len(some):
            at = (np.cumsum(n) - n)[some]
            rows = self.w[x]
            out[some] = np.add.reduceat(rows, at, axis=0) / np.sqrt(n[some])[:, None]
        p = self._softmax((out + self.bias) * self.sharpness)
        p[n == 0] = np.eye(len(FAMILIES))[0]
        return p


def _word_pairs(text: str) -> set:
    words = clean(text).lower().split()
    return set(zip(words, words[1:], strict=False)) or set(words)


class Template:
    """A family's sentence: its word pairs, those with a number, and its words of the family's own."""

    def __init__(self, family: str, text: str) -> None:
        self.family, self.pairs, self.ends = family, _word_pairs(text), "all rights reserved" in text.lower()
        self.numbers = {x for x in self.pairs if any(c.isdigit() for w in x for c in w)} if family != "Proprietary" else set()
        self.own = {w for x in self.pairs for w in x} & OWN_WORDS[family]


KNOWN = [Template(f, t) for f, ts in TEMPLATES.items() for t in ts]
#: Word pair to the numbers of the templates that hold it.
HOLDERS: dict = {}
for _i, _t in enumerate(KNOWN):
    for _p in _t.pairs:
        HOLDERS.setdefault(_p, []).append(_i)


def template_matches(paragraph: str, before: str = "") -> dict[str, float]:
    """Of each family with a template that matches: the largest share of a template's word pairs that the paragraph holds.

    MATCH of the pairs must be there, every number of the template and every word of its own of the family's
    names, and nothing may deny it, ``before`` the paragraph neither. ``paragraph`` may go on behind the notice for a character or two, which show whether a sentence ends.
    """
    own = _word_pairs(paragraph)
    counts = Counter(i for p in own if p in HOLDERS for i in HOLDERS[p])
    out: dict[str, float] = {}
    for i, n in counts.items():
        t = KNOWN[i]
        share = n / len(t.pairs)
        if share >= MATCH and share > out.get(t.family, 0.0) and t.numbers <= own and t.own <= {w for p in own for w in p} and (not t.ends or RESERVED.search(paragraph)):
            out[t.family] = share
    return {} if out and DENIED.search(clean(before + paragraph)) else out


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    """Of each word with the word before it; the first one's means nothing."""
    out = np.zeros(len(words), np.uint64)
    out[1:] = mix(words[1:] ^ mix(words[:-1] + np.uint64(3)))
    return out


def _template_pairs() -> list[tuple[str, np.ndarray, int, int]]:
    """Of each template: family, sorted hashes of its word pairs, least number of them for a match, words of a window."""
    out = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            words, *_ = word_hashes(*_buffers([template]))
            own = np.unique(_pair_hashes(words)[1:])
            out.append((family, own, int(np.ceil(MATCH * len(own) - 1e-9)), 2 * len(words)))
    return out


def windows(part: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(text, family, start, end) of the stretches of words, across wrapped lines, that may hold a template.

    A stretch lies in one paragraph (no line without words inside), has at most twice the template's
    words and at least as many of its word pairs as a match needs; so nothing that matches is left out.
    """
    words, first, starts, lens = word_hashes(PLAIN[part], offs)
    if len(words) < 2:
        return []
    lines = np.concatenate([[0], np.cumsum(part == 10)])
    new = np.ones(len(words), bool)
    new[1:] = lines[starts[1:]] - lines[(starts + lens)[:-1]] > 1
    new[first[:-1][first[:-1] < len(words)]] = True
    paragraph, pair = np.cumsum(new), _pair_hashes(words)
    pair_at = np.flatnonzero(~new)
    known = np.unique(np.concatenate([own for _, own, _, _ in PAIRS]))
    at = np.minimum(np.searchsorted(known, pair[pair_at]), len(known) - 1)
    pair_at = pair_at[known[at] == pair[pair_at]]
    hashes, out = pair[pair_at], []
    for family, own, least, most in PAIRS:
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        hit = pair_at[own[at] == hashes]
        if len(hit) < least:
            continue
        last = hit[least - 1 :]
        begin = np.flatnonzero((last - hit[: len(last)] + 2 <= most) & (paragraph[last] == paragraph[hit[: len(last)]]))
        for i in begin:
            upto = int(np.searchsorted(hit, hit[i] + most - 2, side="right")) - 1
            while paragraph[hit[upto]] != paragraph[hit[i]]:
                upto -= 1
            a, b = int(starts[hit[i] - 1]), int(starts[hit[upto]] + lens[hit[upto]])
            out.append((int(np.searchsorted(offs, a, side="right")) - 1, family, a, b))
    return sorted(set(out))


def closest(part: np.ndarray, offs: np.ndarray, found: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int, int]]:
    """The stretches that match, without those of which half or more lies in a better match of another family."""
    texts = {(a, b): part[a : min(b + BEHIND, int(offs[i + 1]))].tobytes().decode("utf-8", "replace") for i, _, a, b in found}
    matches = {place: template_matches(text) for place, text in texts.items()}
    known = [(a, b, i, family, matches[a, b][family]) for i, family, a, b in found if family in matches[a, b]]
    known.sort()
    begin, longest = [x[0] for x in known], max((x[1] - x[0] for x in known), default=0)
    out = []
    for a, b, i, family, m in known:
        near = known[bisect.bisect_left(begin, a - longest) : bisect.bisect_left(begin, b)]
        if not any(y[4] > m and y[3] != family and 2 * (min(b, y[1]) - max(a, y[0])) >= b - a for y in near):
            out.append((i, family, a, b))
    return out


#: Characters kept as they are; every other ASCII character separates words.
PLAIN = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 10]:
    PLAIN[_b] = _b
PAIRS = _template_pairs()


def paragraphs(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each block of lines between lines without words; comment marks are no words."""
    words, first, starts, lens = word_hashes(PLAIN[part], offs)
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    lines = np.concatenate([[0], np.cumsum(part == 10)])
    new = np.ones(len(words), bool)
    new[1:] = lines[starts[1:]] - lines[(starts + lens)[:-1]] > 1
    new[first[:-1][first[:-1] < len(words)]] = True
    at = np.flatnonzero(new)
    begin, end = starts[at], (starts + lens)[np.append(at[1:], len(words)) - 1]
    return np.searchsorted(offs, begin, side="right") - 1, begin, end


#: Bytes before a stretch in which a denial is looked for, and behind it, in which its sentence may end.
BEFORE, BEHIND = 24, 2


def _scan(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in chunks(offsets):
                part, offs = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                owner, begin, end = paragraphs(part, offs)
                found: list[dict[str, tuple[float, float, int, int]]] = [{} for _ in range(last - first)]

                def note(i: int, p: np.ndarray, a: int, b: int, wanted: str | None = None) -> None:
                    """The family whose template agrees best, of all; among equals the likeliest."""
                    before, text = (part[x:y].tobytes().decode("utf-8", "replace") for x, y in ((max(int(offs[i]), a - BEFORE), a), (a, min(b + BEHIND, int(offs[i + 1])))))
                    match, chance, family = max(((m, float(p[FAMILIES.index(f)]), f) for f, m in template_matches(text, before).items()), default=(0.0, 0.0, ""))
                    if 1 - p[0] >= SURE and family and (wanted is None or family == wanted):
                        old = found[i].get(family)
                        if old is None or match > old[1]:
                            found[i][family] = (chance, match, a - int(offs[i]), b - int(offs[i]))

                if len(owner):
                    p = model.probabilities(PLAIN[part[begin[0] :]], np.append(begin, len(part)) - begin[0])
                    for j in np.flatnonzero(1 - p[:, 0] >= SURE):
                        note(int(owner[j]), p[j], int(begin[j]), int(end[j]))
                more = closest(part, offs, windows(part, offs))
                for at in range(0, len(more), 10_000):
                    some = more[at : at + 10_000]
                    plain = PLAIN[np.concatenate([part[a:b] for *_, a, b in some])]
                    q = model.probabilities(plain, np.cumsum([0, *(b - a for *_, a, b in some)]))
                    for j, (i, family, a, b) in enumerate(some):
                        note(i, q[j], a, b, family)
                rows = [[{"family": k, "probability": v[0], "match": v[1], "start": v[2], "end": v[3]} for k, v in sorted(x.items())] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.bincount(owner, minlength=last - first)), pa.array(rows, NOTICES)], ["doc_id", "n_paragraphs", "notices"])

    return run


NOTICES = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("match", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, notices (family, probability, match, start, end in bytes) of every row.

    n_paragraphs counts blocks of lines between lines without words. The classifier is fitted on the
    driver from variants of the templates and at most NEGATIVES stretches of STRETCH characters, each
    from a place in a text that a hash picks, which stand for the unknown class unless a template
    matches them. Every paragraph of every text is then classified, in tasks that hold the fixed-size
    weights, and so is every stretch within a paragraph that holds enough word pairs of a template,
    unless another family matches the same words better. The family is reported whose template agrees best, at its best
    place; numbers and the words of its own must agree, so versions and relatives are told apart, and a notice
    that is denied ("not licensed under") is none.

    Null and empty texts have no paragraphs and no notices; ids, repeated rows and other columns as in
    ``token_count.count_tokens``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h, size = F.xxhash64("text", F.lit(9)), F.length("text")
    n = rows.where(size > 0).count()
    place = 1 + F.pmod(F.xxhash64("text", F.lit(10)), F.greatest(size - STRETCH, F.lit(1)))
    share = min(1.0, 2 * NEGATIVES / max(1, n))  # a few more than wanted, so that only those are sorted
    sample = rows.where((size > 0) & (F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("doc_id", h.alias("h"), F.substring("text", place.cast("int"), F.lit(STRETCH)).alias("part"))
    parts = [r["part"] for r in sample.orderBy("h", "doc_id").limit(NEGATIVES).select("part").collect()]
    parts = [x for x in parts if not template_matches(x)]
    return rows.mapInArrow(_scan(Classifier(parts)), "doc_id long, n_paragraphs long, notices array<struct<family:string,probability:double,match:double,start:long,end:long>>")
