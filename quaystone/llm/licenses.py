"""License scans (2): a trained paragraph classifier over sparse word n-grams, confirmed against templates.

A paragraph is a line with a word, or neighbouring lines that hold a notice together (hard-wrapped ones). Every line is
classified; those that are given a family or hold a cue word are reported. Runs of lines are classified where they hold most words
of a notice that none of their lines is confirmed for. Its features are its distinct words and word pairs (64-bit hashes, A-Z
lower-cased, outer punctuation dropped). A multinomial logistic regression is trained, on the driver and with a fixed seed, on
variations of the notices and framed names below and on other paragraphs: sentences that sound like notices, a bounded sample of the
documents' own lines, and phrases with most of their words replaced. It has a class ``unknown``; its probabilities are calibrated by one
temperature fitted on phrases that are held out whole. A class ``other`` is for licences of no known family. A prediction counts if it is
a known family (of equal ones the first by name), its probability reaches LEAST_PROBABILITY, and the paragraph grants the family's licence by name, with no
denial and no other family's name beside it, or holds most words of one of its notices. No line of the tables this was tried on is among the phrases.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base
from quaystone.llm.words import mix, word_hashes

UNKNOWN = "unknown"
#: Fixed values. What notices of each family say, clause by clause.
NOTICES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain by waiving all rights worldwide under copyright law.",
    ],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the Attribution terms: you must give appropriate credit."],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc-by-nc": ["You may not use the material for commercial purposes. Attribution-NonCommercial."],
    "cc-by-nc-sa": ["You may not use the material for commercial purposes, and you must distribute your contributions under the same license as the original. Attribution-NonCommercial-ShareAlike."],
    "cc-by-nc-nd": ["You may not use the material for commercial purposes, and you may not distribute the modified material. Attribution-NonCommercial-NoDerivatives."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "cc-by-nd": ["If you remix, transform, or build upon the material, you may not distribute the modified material."],
    "proprietary": ["No part of this publication may be reproduced without the prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Fixed values. How licences are named, and what is said around a name.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 license", "the Apache License 2.0", "Apache-2.0", "the Apache Software License", "the Apache License"],
    "mit": ["the MIT License", "MIT", "an MIT-style license", "the Expat License", "the MIT/X11 license"],
    "bsd": ["the BSD License", "a BSD-style license", "the 3-clause BSD license", "the BSD 2-Clause License", "BSD-3-Clause", "the New BSD License", "BSD"],
    "gpl": ["the GNU General Public License", "the GNU General Public License, version 3", "the GNU GPL", "GPLv3", "GPLv2", "the GPL", "GPL-3.0-or-later", "GPL-2.0-only"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU Lesser General Public License, version 2.1", "the GNU LGPL", "LGPLv3", "LGPL-2.1-only", "the LGPL"],
    "agpl": ["the GNU Affero General Public License", "the GNU Affero General Public License, version 3", "the GNU AGPL", "AGPLv3", "AGPL-3.0-only", "the AGPL"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License", "MPL-2.0", "the MPL 2.0"],
    "cc0": ["CC0 1.0", "CC0", "the CC0 public domain dedication", "Creative Commons Zero", "CC0-1.0"],
    "cc-by": ["CC BY", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution License", "a Creative Commons Attribution 3.0 license"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial License"],
    "cc-by-nd": ["CC BY-ND", "CC BY-ND 4.0", "CC BY-ND 3.0", "CC-BY-ND-4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "the Creative Commons Attribution-NoDerivatives License"],
    "cc-by-nc-sa": ["CC BY-NC-SA", "CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "CC-BY-NC-SA-4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "the Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "cc-by-nc-nd": ["CC BY-NC-ND", "CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "CC-BY-NC-ND-4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "the Creative Commons Attribution-NonCommercial-NoDerivatives License"],
    "isc": ["the ISC License", "ISC", "an ISC-style license"],
    "zlib": ["the zlib License", "the zlib/libpng license", "zlib"],
    "boost": ["the Boost Software License, Version 1.0", "the Boost Software License", "BSL-1.0"],
    "unlicense": ["the Unlicense", "Unlicense"],
    "epl-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License", "EPL-2.0", "the EPL 2.0"],
    "proprietary": ["all rights reserved", "proprietary and confidential"],
}
FRAMES = [
    "This code is distributed under the terms of {}.", "Content on this site is available under {}.", "Use of this source code is governed by {}.", "The project uses {}.", "License: {}", "Copyright 2004 Some Author. {} licensed.", "see {} for details",
    "{} licensed", "offered to you under {}", "This file is licensed to you under {}", "We have released the whole series under {}", "It may be used under {}", "Its text is subject to {};", "The tables are covered by {}", "SPDX id of this file: {}",
]
#: Frames of names that aren't a licence one is under.
CLAIMS = ["Copyright (c) 2021 The Authors. {}", "(c) 1998 Example Press, {}", "This document is {}", "The figures in it are {}", "{} by the publisher and its heirs."]
#: The family of what is a licence of none of the others. It is never confirmed; its names are made up.
OTHER = "other"
MADE_UP = ["Frob", "Quillon", "Marrow", "Tessel", "Oakum", "Varda", "Lumen", "Pardo", "Zephyr", "Nimbus", "Harrow", "Solano"]
NAMES[OTHER] = [f.format(w) for w in MADE_UP for f in ("the {} License", "the {} Public License, version 2", "the {} Open License 1.1")]
NOTICES[OTHER] = ["You may copy and share this work as long as this notice stays with it and no fee is asked.", "This license applies to all files of the distribution unless a file says otherwise."]
#: Fixed values. Parts of notices that are too short to be told by most of their words, and what stands for a name in them.
CLAUSES = {"gpl": ["either version 2 of the License, or (at your option) any later version.", "or, at your option, any later version of the License"]}
CLAUSE_NAMES = {"gpl": ["at your option any later version"]}
#: Fixed values. Paragraphs that speak like notices and are none.
OTHERS = [
    "She had her driving license renewed at the town hall.", "A licensed plumber has to check the pipes.", "The license plate was found by the river.", "Copyright law protects authors and their heirs.", "All seats are reserved for members.",
    "The Apache helicopter landed at noon.", "He studied physics at MIT and moved to Boston.", "The general public may enter the library from ten.", "Permission to build was granted by the council.", "Redistribution of income was debated in parliament.",
    "The software is provided by a vendor under a contract.", "You can redistribute the chairs and modify the room.", "Creative people in the commons shared their bread.", "The version of the play was published by the foundation.", "His rights as a citizen were reserved by the court.",
    "The fishing licence costs twelve euros a year.", "Licences for street stalls are issued on Mondays.", "The following conditions apply to all tickets.", "A copy of this letter was sent free of charge to any person who asked.", "The warranty covers any kind of defect for two years.",
    "Ask for permission before you copy the notice.", "The public domain of the castle is open to visitors.", "The bank licensed under its old name has closed.", "Please read the terms and conditions of travel.", "The Mozilla festival takes place in autumn.", "The source of the river is binary in form on this map.",
    "Published by the author in 2004, version 2.", "The gnu is a large antelope of the general plains.", "The attribution of the painting is disputed.", "Commercial purposes are not the aim of the museum.", "Copyright 2004 Some Author.", "This license has expired.", "See the license for details.", "MIT researchers published a paper on licenses.", "The library isn't under any license yet.", "A lecture on the GPL and its history.", "BSD was first released in Berkeley.", "The Mozilla Foundation has a new chair.",
]
#: Lines of the documents used as examples of ``unknown``, at most, and documents they are from: those with the least hashes.
OTHER_DOCUMENTS, OTHER_LINES = 200, 2_000
LEAST_PROBABILITY, LEAST_COVER = 0.6, 0.75
_EDGE = ".,;:()[]{}\"'!?*#"
#: Fixed values. Words by which a licence is granted within GRANT_REACH words before its name, and words that undo it within DENIAL_REACH.
GRANTS = frozenset("under license licensed licence licenced licensing terms governed subject available released distributed offered covered uses spdx spdx-license-identifier".split())
DENIALS = frozenset("not no never neither nor without isn't aren't wasn't weren't don't doesn't cannot can't unlike instead against formerly previously".split())
GRANT_REACH, DENIAL_REACH = 6, 10
_AFTER = frozenset("license licensed licence licenced licenses".split())
#: Fixed values. What a reported paragraph speaks of.
_CUE_WORDS = ("licenc", "licens", "copyright", "rights reserved", "permission", "redistribut", "spdx", "public domain", "waived", "reproduced", "proprietary", "mozilla")
_CUES = re.compile("|".join(_CUE_WORDS), re.I)


def _plain(text: str) -> str:
    return " ".join(w.strip(_EDGE) for w in re.split("[\x20\x09-\x0d]+", text) if w.strip(_EDGE))


def _features(line: str) -> tuple[np.ndarray, int]:
    """Hashes of a line's distinct words and word pairs, and the number of all of them."""
    raw = np.frombuffer(_plain(line).encode(), np.uint8)
    words, _ = word_hashes(raw, np.array([0, len(raw)]))
    pairs = mix(mix(words[:-1] + np.uint64(0xD6E8FEB8)) ^ words[1:])
    return np.unique(np.concatenate([words, pairs])), len(words) + len(pairs)


@dataclass
class LicenseModel:
    families: list[str]
    keys: np.ndarray  # sorted hashes of known features
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    temperature: float
    cues: re.Pattern
    templates: dict[str, list[tuple[frozenset[str], frozenset[str]]]]  # words of notices, and those in no other family's
    by_first: dict[str, list[tuple[tuple[str, ...], str]]]  # names of licences as words, and their families, by the first word
    signature: np.ndarray  # sorted hashes of words of which every text that covers a notice has one

    @cached_property
    def notice_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the notices' words, which notice has which, and how many words of each a text must hold to cover it."""
        notices = [t for ts in self.templates.values() for t, _ in ts]
        words = sorted(frozenset().union(*notices))
        hashes = np.array([word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in words])
        order = np.argsort(hashes)
        return hashes[order], np.array([[words[i] in t for t in notices] for i in order], np.float32), LEAST_COVER * np.array([len(t) for t in notices], np.float32)

    def may_cover(self, words: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        """Whether each text holds enough words of some notice, wherever they stand. text: that of each word."""
        hashes, of, least = self.notice_words
        at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        held = hashes[at] == words
        there = np.zeros((n_texts, len(hashes)), np.float32)
        there[text[held], at[held]] = 1
        return (there @ of >= least).any(axis=1)

    def line_logits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits of many lines at once, from their words' hashes and n+1 offsets."""
        n, owner = len(first) - 1, np.repeat(np.arange(len(first) - 1), np.diff(first))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        found = np.concatenate([words, mix(mix(words[inner] + np.uint64(0xD6E8FEB8)) ^ words[inner + 1])])
        owner = np.concatenate([owner, owner[inner]])
        size = np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))
        # few features are known: most others are told by 16 of their bits
        table = np.zeros(1 << 16, bool)
        table[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = table[(found & np.uint64(0xFFFF)).astype(np.int64)]
        found, owner = found[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        held = self.keys[at] == found
        once = np.unique(owner[held] * len(self.keys) + at[held])  # each feature of a line counts once
        owner, at = once // len(self.keys), once % len(self.keys)
        sums = np.stack([np.bincount(owner, self.weights[at, k], n) for k in range(len(self.families))], axis=1)
        return sums / size[:, None] + self.bias

    def probabilities(self, lines: list[str]) -> np.ndarray:
        logits = np.stack([self._logits(_features(x)) for x in lines]) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _logits(self, features: tuple[np.ndarray, int]) -> np.ndarray:
        found, n = features
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        at = at[self.keys[at] == found]
        return self.weights[at].sum(axis=0) / np.sqrt(max(1, n)) + self.bias

    def named(self, line: str) -> dict[str, bool]:
        """Families whose licences the line names, and whether it grants one of theirs.

        A name is granted if nothing denies it within DENIAL_REACH words before it and a word of GRANTS stands within GRANT_REACH (before a single
        word of letters, which may mean something else as well, within three); or it follows a colon, or with a version or hyphen a comma; or it begins the
        line (such a single word only as all of it); or ``licensed`` or ``license`` comes after it. Rights that are reserved need no grant. Of
        names that begin at the same word the longest counts, and a name is whole words: BY-NC-SA is no BY-NC.
        """
        raw = [w for w in re.split("[\x20\x09-\x0d]+", line) if w.strip(_EDGE)]
        words = [w.strip(_EDGE).lower() for w in raw]
        out: dict[str, bool] = {}
        at = 0
        while at < len(words):
            held = [(len(n), f) for n, f in self.by_first.get(words[at], ()) if tuple(words[at : at + len(n)]) == n]
            if not held:
                at += 1
                continue
            size, family = max(held)
            before, after = words[max(0, at - GRANT_REACH) : at], words[at + size : at + size + 1]
            plain = size == 1 and words[at].isalpha()
            next_to = bool(after) and after[0] in _AFTER
            last = next((w for w in reversed(raw[:at]) if w.lower() not in ("the", "a", "an")), "")
            precise = any(c.isdigit() or c == "-" for w in words[at : at + size] for c in w)
            opens = last.endswith(":") or precise and last.endswith((",", ";")) or not before and (not plain or len(words) == 1)
            granted = family == "proprietary" or next_to or opens or any(w in GRANTS for w in (before[-3:] if plain else before))
            denied = any(w in DENIALS or w.endswith("n't") for w in words[max(0, at - DENIAL_REACH) : at])
            out[family] = out.get(family, False) or (granted and not denied)
            at += size
        return out

    def cover(self, line: str, family: str) -> float:
        """1 if the line grants a licence of the family by name and names no other family's. Otherwise the largest share of a notice's words that the line holds, among notices whose telling words (in no other family's) it has or that have over three words. Of OTHER, 0."""
        if family == OTHER:
            return 0.0
        named = self.named(line)
        if named.get(family) and len(named) == 1:
            return 1.0
        words = set(_plain(line).lower().split())
        return max((len(words & t) / len(t) for t, telling in self.templates[family] if telling <= words or len(telling) > 3), default=0.0)


def _variations(rng: np.random.Generator, notice: str, fillers: list[str], n: int) -> list[str]:
    """The notice as it is, and with a word dropped, words before or after it, other case or punctuation."""
    out = [notice]
    for _ in range(n):
        words = notice.split()
        if len(words) > 6 and rng.random() < 0.4:
            del words[rng.integers(len(words))]
        if rng.random() < 0.5:
            words = [*rng.choice(fillers, rng.integers(1, 6)), *words]
        if rng.random() < 0.5:
            words = [*words, *rng.choice(fillers, rng.integers(1, 6))]
        text = " ".join(words)
        out.append(text.upper() if rng.random() < 0.1 else text.rstrip(".") if rng.random() < 0.3 else text)
    return out


def phrases() -> list[tuple[str, str]]:
    """(family, text) of all notices, clauses and framed names."""
    framed = [(f, (c if c[0] == "{" or "." not in n else c).format(n)) for f, names in NAMES.items() for n in names for c in (CLAIMS if f == "proprietary" else FRAMES)]
    return [(f, n) for given in (NOTICES, CLAUSES) for f, notices in given.items() for n in notices] + framed


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(others: list[str], seed: int = 11, steps: int = 150) -> LicenseModel:
    """Fit to variations of the phrases, to OTHERS and to ``others``: paragraphs of documents. Of those, the ones that hold a licence's name or most of a notice aren't examples of ``unknown``.

    A fifth of the phrases and of the other paragraphs is held out, with all its variations; the temperature is fitted to it.
    """
    rng = np.random.default_rng(seed)
    families = sorted(NOTICES)
    of = {f: [frozenset(_plain(n).lower().split()) for n in notices] for f, notices in NOTICES.items() if f != OTHER}
    templates = {f: [(t, t - frozenset().union(*(x for g, xs in of.items() if g != f for x in xs))) for t in ts] for f, ts in of.items()}
    bare = lambda n: re.sub("^(the|an?) ", "", _plain(n).lower())
    by_first: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for f, ns in NAMES.items():
        for n in sorted({tuple(bare(n).split()) for n in [*ns, *CLAUSE_NAMES.get(f, ())]}) if f != OTHER else ():
            by_first.setdefault(n[0], []).append((n, f))
    # a cover of LEAST_COVER lacks at most this many words of a notice, so it has one of any set that is larger by one
    lacking = lambda t: next(k for k in range(len(t) + 1) if (len(t) - k - 1) / len(t) < LEAST_COVER)
    signature = {w for ts in templates.values() for t, telling in ts for w in sorted(t, key=lambda w: (w not in telling, -len(w), w))[: lacking(t) + 1]}
    hashes = np.array([word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in signature])
    model = LicenseModel([*families, UNKNOWN], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0), 1.0, _CUES, templates, by_first, np.sort(hashes))
    others = [x for x in others if x.strip() and not any(model.cover(x, f) >= LEAST_COVER for f in families)][:OTHER_LINES]
    fillers = sorted({w for x in [*others, *OTHERS] for w in x.split()[:20] if len(w) < 30})[:4000]
    telling = sorted({w for _, x in phrases() for w in _plain(x).lower().split()})
    texts, labels, held = [], [], []

    def add(some: list[str], label: int) -> None:
        kept_out = rng.random() < 0.2
        texts.extend(some)
        labels.extend([label] * len(some))
        held.extend([kept_out] * len(some))

    for family, phrase in phrases():
        add(_variations(rng, phrase, fillers, 10 if len(phrase.split()) > 12 else 3), families.index(family))
        words = [w if rng.random() < 0.35 else str(rng.choice(fillers)) for w in phrase.split()]
        if len(words) > 2 and not any(model.cover(" ".join(words), f) >= LEAST_COVER for f in families):
            add([" ".join(words)], len(families))  # the frame of a notice without what tells its family
    for x in OTHERS:
        add(_variations(rng, x, fillers, 12), len(families))
    for x in others:
        add([x], len(families))
    for _ in range(600):  # single telling words among others say nothing
        add([" ".join(rng.permutation([*rng.choice(fillers, 8), *rng.choice(telling, 1)]))], len(families))
    (found, n), y, held = zip(*map(_features, texts), strict=True), np.array(labels), np.array(held)
    keys, times = np.unique(np.concatenate([f for f, label in zip(found, y, strict=True) if label < len(families)]), return_counts=True)
    keys = keys[times > 1]
    size = np.sqrt(np.maximum(1, np.array(n, np.float32)))
    x = np.zeros((len(found), len(keys) + 1), np.float32)  # some thousands each way; the last column is the bias
    for i, f in enumerate(found):
        x[i, np.searchsorted(keys, f[np.isin(f, keys)])] = 1 / size[i]
    x[:, -1] = 1
    # classes weigh the same on the whole, but for ``unknown``, which weighs as five
    learned = x[~held]
    t, onehot = y[~held], np.eye(len(families) + 1, dtype=np.float32)[y[~held]]
    weight = np.where(t == len(families), 5.0, 1.0) / np.bincount(t, minlength=len(families) + 1)[t]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w = np.zeros((len(keys) + 1, len(families) + 1), np.float32)
    velocity = np.zeros_like(w)
    for _ in range(steps):
        velocity = 0.9 * velocity - 20 * (learned.T @ ((_softmax(learned @ w) - onehot) * weight)) - 2e-5 * w
        w += velocity
    w, b = w[:-1].astype(np.float64), w[-1].astype(np.float64)
    t_held = y[held]
    z = x[held] @ np.vstack([w, b])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(t_held)), t_held] + 1e-12).mean()
    model.keys, model.weights, model.bias, model.temperature = keys, w, b, float(min(np.linspace(0.2, 4, 39), key=loss)) if len(t_held) else 1.0
    return model


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("paragraph", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("cover", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])


def _without_edges(raw: np.ndarray) -> np.ndarray:
    """The bytes with spaces for the outer punctuation of words."""
    edge, space = np.zeros(256, bool), np.zeros(256, bool)
    edge[list(_EDGE.encode())] = True
    space[[0x20, *range(0x09, 0x0E)]] = True
    is_edge, at = edge[raw], np.arange(len(raw))
    outside = np.append(space[raw], True)  # the last place stands for both ends
    before = np.maximum.accumulate(np.where(is_edge, -1, at))
    after = np.minimum.accumulate(np.where(is_edge, len(raw), at)[::-1])[::-1]
    return np.where(is_edge & (outside[before] | outside[after]), np.uint8(0x20), raw)


def _wrapped(m: LicenseModel, lines: list[str], hit: np.ndarray, sure: dict[int, str]) -> list[tuple]:
    """(first line, last line, family, probability, cover) of runs of two lines or more that hold a notice together, tightest first.

    No line of a run holds the notice alone. Runs don't go over blank lines or lines confirmed for other families (``sure``); between
    their outer lines they have fewer words than the longest notice.
    """
    longest = max(len(t) for ts in m.templates.values() for t, _ in ts)
    near = np.append(0, np.cumsum(hit))
    words = [_plain(x).split() for x in lines]
    low = [frozenset(w.lower() for w in ws) for ws in words]
    said = frozenset().union(*low)  # a run has no more words of a notice than the text has
    live = {f: [(t, telling) for t, telling in ts if len(said & t) >= LEAST_COVER * len(t)] for f, ts in m.templates.items()}
    live = {f: ts for f, ts in live.items() if ts}
    if not live:
        return []
    candidates = []
    for i in range(len(lines)):
        inner, j = 0, i + 1
        run, families = list(words[i]), {sure[i]} if i in sure else set()
        while words[i] and j < len(lines) and words[j] and inner < longest and len(families := families | ({sure[j]} if j in sure else set())) < 2:
            run += words[j]
            if near[j + 1] > near[i]:
                together = frozenset().union(*low[i : j + 1])
                for family in (f for f in families or live if f in live):
                    held = [t for t, telling in live[family] if (telling <= together or len(telling) > 3) and all(len(x & t) < LEAST_COVER * len(t) for x in low[i : j + 1])]
                    cover, t = max(((len(together & t) / len(t), t) for t in held), key=lambda x: x[0], default=(0.0, None))
                    if cover >= LEAST_COVER:
                        inside = [k for k, w in enumerate(run) if w.lower() in t]
                        candidates.append((j - i, i, j, family, cover, " ".join(run[inside[0] : inside[-1] + 1])))
            inner += len(words[j])
            j += 1
    rated = []
    for (size, i, j, family, cover, _), p in zip(candidates, m.probabilities([c[-1] for c in candidates]) if candidates else (), strict=True):
        best = int(p.argmax())
        if m.families[best] == family and p[best] >= LEAST_PROBABILITY:
            rated.append((size, -cover, -float(p[best]), i, j, family))
    out, taken = [], set()
    for _, cover, p, i, j, family in sorted(rated):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((i, j, family, -p, -cover))
    return out


def _scan(model, per_document: bool):
    def found_in(texts: list[str]) -> Iterator[list[tuple]]:
        m = model.value
        raw = _without_edges(np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8))
        words, first = word_hashes(raw, np.concatenate([[0], np.flatnonzero(raw == 0x0A) + 1, [len(raw)]]))
        z = m.line_logits(words, first) / m.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        probabilities, best = e / e.sum(axis=1, keepdims=True), z.argmax(axis=1)
        named = (best != len(m.families) - 1) & (np.diff(first) > 0)
        at = np.minimum(np.searchsorted(m.signature, words), len(m.signature) - 1)
        hit = np.zeros(len(named), bool)
        hit[np.repeat(np.arange(len(named)), np.diff(first))[m.signature[at] == words]] = True
        n_lines = np.array([text.count("\n") + 1 for text in texts])
        run = m.may_cover(words, np.repeat(np.repeat(np.arange(len(texts)), n_lines), np.diff(first)), len(texts))
        from_line = 0
        for text, runs in zip(texts, run.tolist(), strict=True):
            to_line = from_line + text.count("\n") + 1
            mine = slice(from_line, to_line)
            from_line = to_line
            low = text.lower()
            spoken = any(c in low for c in _CUE_WORDS)
            if not spoken and not named[mine].any() and not runs:
                yield []
                continue
            lines, out, sure = text.split("\n"), {}, {}
            starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
            for k, line in enumerate(lines):
                if not (named[mine][k] or spoken and m.cues.search(line)):
                    continue
                of = int(best[mine][k])
                family, p = m.families[of], float(probabilities[mine][k, of])
                cover = m.cover(line, family) if family != UNKNOWN else 0.0
                out[k] = (k, int(starts[k]), len(line), family, p, cover, family != UNKNOWN and p >= LEAST_PROBABILITY and cover >= LEAST_COVER)
                if out[k][-1]:
                    sure[k] = family
            for i, j, family, p, cover in _wrapped(m, lines, hit[mine], sure) if runs else ():
                for k in range(i, j + 1):
                    out.pop(k, None)
                out[i] = (i, int(starts[i]), int(starts[j] + len(lines[j]) - starts[i]), family, p, cover, True)
            yield [out[k] for k in sorted(out)]

    def paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            rows = [(i, *x) for i, found in zip(batch.column(0).to_pylist(), found_in(batch.column(1).fill_null("").to_pylist()), strict=True) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), pa.schema(_ARROW).types, strict=True)], names=_FOUND.names)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            rows = []
            for found in found_in(batch.column(1).fill_null("").to_pylist()):
                sure = [x for x in found if x[6]]
                rows.append((sorted({x[3] for x in sure}), len(sure), len(found) - len(sure), max([x[4] for x in sure], default=None)))
            families, sure, unsure, best = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(families, pa.list_(pa.string())), pa.array(sure, pa.int64()), pa.array(unsure, pa.int64()), pa.array(best, pa.float64())], names=_PER_DOCUMENT.names)

    return documents if per_document else paragraphs


_ARROW = [("doc_id", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64()), ("confirmed", pa.bool_())]
_PER_DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("families", T.ArrayType(T.StringType())), T.StructField("n_confirmed", T.LongType()), T.StructField("n_unknown", T.LongType()), T.StructField("probability", T.DoubleType())])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Train with up to OTHER_LINES lines of OTHER_DOCUMENTS documents as examples of other paragraphs.

    A model is stored on shared storage under a digest of all that it is fitted to, and taken from there where it has been fitted before.
    """
    rows = base.id_and_text(docs, id_col, text_col).where("text is not null and doc_id is not null")
    some = base.least_hashes(rows.select("doc_id"), OTHER_DOCUMENTS, "doc_id").distinct().collect()  # ids alone
    chosen = rows.where(F.col("doc_id").isin([r["doc_id"] for r in some]))
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return stored_model(docs.sparkSession, [r["line"] for r in base.least_hashes(lines, OTHER_LINES, "line").collect()])


def stored_model(spark: SparkSession, others: list[str]) -> LicenseModel:
    named = hashlib.sha256(repr((phrases(), OTHERS, sorted(others), sorted(GRANTS), sorted(DENIALS))).encode()).hexdigest()
    path = f"{base.shared_dir(spark)}/quaystone/models/licenses-{named}"
    if base.exists(spark, f"{path}/_SUCCESS"):
        return pickle.loads(spark.read.schema("model binary").parquet(path).first()["model"])
    model = train(sorted(others))
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model


def scan_licenses(docs: DataFrame, model: LicenseModel, per_document: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph that speaks of a licence: doc_id, paragraph (its first line's number), start, length (characters), family, probability, cover, confirmed.

    ``per_document``: a row for each input row instead: doc_id, families (confirmed ones, sorted), n_confirmed, n_unknown (paragraphs that aren't), probability
    (of the surest; null without one). Null and empty texts have no paragraphs; repeated rows and null ids are scanned each for
    itself; other columns aren't read; an empty table gives none. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.id_and_text(docs, id_col, text_col).mapInArrow(_scan(shared, per_document), _PER_DOCUMENT if per_document else _FOUND)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    return scan_licenses(docs, fit(docs), per_document=True)
