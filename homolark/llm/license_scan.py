"""Licence scan by a trained paragraph classifier.

Paragraphs (parted by blank lines) are classified by multinomial logistic regression over hashed word 1- to 3-grams into licence
families and an unknown class. It is trained here: positives are the families' templates with drawn-in variations, and notices that name a family in drawn words;
negatives are a bounded sample of the corpus' own paragraphs that hold no template: of about `SAMPLED` documents by hash of the text up to `EACH` windows
by hash, of these the `NEGATIVES` with the lowest hashes, documented bounds that do not depend on how files are split. Probabilities are calibrated by a
temperature fitted on held-out paragraphs, and a window is
searched if the families together reach `CONFIDENT` (notices of two families share the probability). Then templates decide, each family
for itself: five-word shingles (all words if fewer) of a template found in one place at `CONFIRM` or more, or a template with slots, a lead ("licensed under", "available under the terms of the", an
identifier's key) before one of the family's names; a short paragraph may hold a full name alone. A long paragraph is
classified by windows of `SPAN` words with half overlap. Each place is a notice, at the line where it begins, so a line may hold several and a notice may be
wrapped over lines; `probability` is that of the families together, in the surest window that the place touches.

Output has a row per document. Null text has no paragraphs; texts of any length are read whole. Rows are judged independently, repeated ones alike; a null
doc_id is carried as null. Equal hashes in the sample go in order of the text. An empty table gives an empty result, and columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, mix, tune, utf8, words

# fixed values: families and the wording of their notices
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3."),
    "LGPL-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 3."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "All-rights-reserved": ("All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
# fixed values: names of the families, as words
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache license v2", "apache 2.0 license", "apache software license 2.0", "apache 2.0", "apache-2.0", "apache v2", "asl 2.0"),
    "MIT": ("mit license", "mit licence", "expat license", "mit"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3.0", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gnu gplv3", "gpl version 3", "gpl v3", "gpl 3.0", "gplv3", "gpl3", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"),
    "CC-BY-NC-4.0": ("creative commons attribution-noncommercial 4.0 international license", "creative commons attribution-noncommercial license", "creative commons attribution-noncommercial 4.0", "cc by-nc 4.0", "cc-by-nc-4.0", "cc-by-nc 4.0", "cc by-nc"),
    "CC-BY-4.0": ("creative commons attribution 4.0 international license", "creative commons attribution license", "creative commons attribution 4.0", "cc by 4.0", "cc-by-4.0", "cc-by 4.0"),
    "BSD-3-Clause": ("bsd 3-clause license", "3-clause bsd license", "three-clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3-clause", "3-clause bsd", "bsd-3-clause"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v 2.0", "mozilla public license v2.0", "mozilla public license 2.0", "mpl 2.0", "mpl v2.0", "mpl-2.0", "mplv2"),
    "CC-BY-SA-4.0": ("creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike license", "creative commons attribution-sharealike 4.0", "cc by-sa 4.0", "cc-by-sa-4.0", "cc-by-sa 4.0", "cc by-sa"),
    "CC0-1.0": ("cc0 1.0 universal", "creative commons zero", "cc0 1.0", "cc0-1.0", "cc0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3.0", "gnu affero general public license v3", "gnu agpl version 3", "gnu agpl v3", "gnu agplv3", "agpl v3", "agplv3", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3.0", "gnu lesser general public license v3", "gnu lgpl version 3", "gnu lgpl v3", "gnu lgplv3", "lgpl v3", "lgplv3", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"),
    "ISC": ("isc license", "isc licence", "isc"),
    "Unlicense": ("the unlicense", "unlicense license", "unlicense"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license 2.0", "epl 2.0", "epl-2.0", "epl v2.0"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license 1.0", "boost software license", "bsl-1.0"),
}
# fixed values: what stands before a name in a notice, and what may stand between
LEADS = ("licensed", "licenced", "licensing", "released", "distributed", "redistributed", "available", "published", "provided", "offered", "issued", "shared", "covered", "governed", "dual-licensed", "multi-licensed")
BETWEEN = ("the", "terms", "conditions", "of", "and", "a", "an", "open", "source", "permissive", "free", "standard", "software", "either")
GAP = 6
HEADING = 8  # words of a paragraph that may be a name alone
FAMILIES = ("unknown", *TEMPLATES)
FILLER = "please note that the following text is made available by its authors and contributors see notice file for details copyright holders 2019 2021 project work content".split()
BITS = 15
SPAN = 16
NEGATIVES = 20_000
SAMPLED, EACH = 4_000, 12
CONFIDENT = 0.8
CONFIRM = 0.8
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def plain(text: str) -> list[str]:
    return _WORD.findall(text.lower())


LONGEST = max(len(plain(t)) for ts in TEMPLATES.values() for t in ts) + 5


def grams(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature of the 1-, 2- and 3-gram that starts at each word (BITS bits each); -1 where it would leave the paragraph."""
    out = np.full((len(h), 3), -1, np.int64)
    g = h
    at = np.arange(len(h))
    for k in range(3):
        if k:
            g = mix(g[: len(h) - k] * U(0xD6E8FEB86659FD93) + h[k:] + U(k)) if len(h) > k else g[:0]
        ok = at[: len(g)] + k < ends[: len(g)]
        out[: len(g), k] = np.where(ok, (g >> U(64 - BITS)).astype(np.int64), -1)
    return out


class Paragraphs:
    """Windows of up to SPAN words of all paragraphs of a batch of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = LOWER[data] if len(data) else data
        ok = np.zeros(256, bool)
        ok[np.arange(48, 58)] = ok[np.arange(97, 123)] = ok[128:] = True
        clean = np.where(ok[low] | (low == 10), low, 32).astype(np.uint8) if len(low) else low
        s, e, first, h = words(clean, off)
        nl = np.flatnonzero(data == 10)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        line = np.searchsorted(nl, s)
        fresh = np.ones(len(s), bool)
        fresh[1:] = (line[1:] - line[:-1] > 1) | (row[1:] != row[:-1])
        w0 = np.flatnonzero(fresh)
        n = np.diff(np.append(w0, len(s)))
        per = np.maximum(1, -(-(n - SPAN // 2) // (SPAN // 2)))
        k = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        self.lo = np.repeat(w0, per) + k * (SPAN // 2)
        self.begin, self.end = np.repeat(w0, per), np.repeat(w0 + n, per)
        self.hi = np.minimum(self.lo + SPAN, self.end)
        self.row = row[self.lo] if len(self.lo) else self.lo
        self.feeds, self.before = nl, np.searchsorted(nl, off)
        self.paragraph = np.repeat(np.arange(len(w0)), per)
        self.starts, self.ends, self.data = s, e, data
        self.of_row = np.bincount(row[w0], minlength=len(off) - 1) if len(w0) else np.zeros(len(off) - 1, np.int64)
        self.features = grams(h, np.repeat(w0 + n, n)) if len(s) else np.zeros((0, 3), np.int64)

    def region(self, i: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, and where in the data they start and end, of text(i)."""
        a, b = max(self.begin[i], self.lo[i] - LONGEST), min(self.end[i], self.hi[i] + LONGEST)
        found = list(_WORD.finditer(self.data[self.starts[a] : self.ends[b - 1]].tobytes().decode("latin-1").lower()))  # a character a byte
        return [m[0] for m in found], *(self.starts[a] + np.array([getattr(m, x)() for m in found], np.int64) for x in ("start", "end"))

    def line(self, row: int, place: int) -> int:
        """Number of the line of a text that a place in the data is in."""
        return int(np.searchsorted(self.feeds, place) - self.before[row])

    def text(self, i: int) -> str:
        """A window's paragraph, as far as a template that touches the window may reach."""
        a, b = max(self.begin[i], self.lo[i] - LONGEST), min(self.end[i], self.hi[i] + LONGEST)
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes().decode("utf-8", "replace")


class Classifier:
    def __init__(self, seed: int = 7):
        self.w = np.zeros(((1 << BITS) + 1, len(FAMILIES)), np.float32)  # the last row is of absent features
        self.b = np.zeros(len(FAMILIES), np.float32)
        self.scale, self.rng = 1.0, np.random.default_rng(seed)

    def logits(self, p: Paragraphs) -> np.ndarray:
        if not len(p.lo):
            return np.zeros((0, len(FAMILIES)))
        f = np.concatenate([p.features, np.full((1, 3), -1, np.int64)])
        each = np.zeros((len(f) + 1, len(FAMILIES)))
        np.cumsum(self.w[f].sum(1), 0, dtype=np.float64, out=each[1:])
        n = (p.hi - p.lo)[:, None]
        return (each[p.hi] - each[p.lo]) / np.sqrt(n) + self.b

    def probabilities(self, p: Paragraphs) -> np.ndarray:
        z = self.logits(p) / self.scale
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True) if len(z) else z

    def _sums(self, p: Paragraphs, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logits of some paragraphs before the temperature, with their features, whose each is, and the paragraphs' scales."""
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        f, who = p.features[at].ravel(), np.repeat(np.repeat(np.arange(len(n)), n), 3)
        scale = (1 / np.sqrt(n)).astype(np.float32)
        z = np.zeros((len(n), len(FAMILIES)), np.float32)
        np.add.at(z, who, self.w[f])
        return z * scale[:, None] + self.b, f, who, scale

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = 8, rate: float = 0.5, l2: float = 1e-5) -> None:
        """Minibatch AdaGrad; a fifth is held out to fit the temperature."""
        p = Paragraphs(*utf8(pa.array([t.replace("\n", " ") for t in texts])))
        one = np.unique(p.row, return_index=True)[1]
        lo, hi, y = p.begin[one], np.minimum(p.end[one], p.begin[one] + 2 * SPAN), y[p.row[one]]
        held = self.rng.random(len(one)) < 0.2
        grad2 = np.full(self.w.shape, 1e-2, np.float32)
        train = np.flatnonzero(~held)
        for _ in range(epochs):
            self.rng.shuffle(train)
            for a in range(0, len(train), 256):
                i = train[a : a + 256]
                z, f, who, scale = self._sums(p, lo[i], hi[i])
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(i)), y[i]] -= 1
                self.b -= rate * z.mean(0)
                g = z * scale[:, None]
                u, back = np.unique(f, return_inverse=True)
                d = np.zeros((len(u), len(FAMILIES)), np.float32)
                np.add.at(d, back, g[who])
                d += l2 * self.w[u]
                grad2[u] += d * d
                self.w[u] -= rate * d / np.sqrt(grad2[u])
                self.w[-1] = 0
        held = np.flatnonzero(held)
        z, t = np.concatenate([np.zeros((0, len(FAMILIES))), *(self._sums(p, lo[i], hi[i])[0] for i in np.array_split(held, 1 + len(held) // 256))]), y[held]
        loss = lambda s: float(np.mean(np.log(np.exp((z - z.max(1, keepdims=True)) / s).sum(1)) - ((z - z.max(1, keepdims=True)) / s)[np.arange(len(t)), t])) if len(t) else 0.0
        self.scale = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0), key=loss)


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


SHINGLES = {f: [(t, shingles(plain(t))) for t in ts] for f, ts in TEMPLATES.items()}


TEMPLATE_AT = [(f, t, need, len(plain(t)) + 5) for f, ts in SHINGLES.items() for t, need in ts]
INDEX: dict[tuple, list[int]] = {}
for _k, (_f, _t, _need, _reach) in enumerate(TEMPLATE_AT):
    for _x in _need:
        INDEX.setdefault(_x, []).append(_k)
SIZES = sorted({len(x) for x in INDEX})
NAMED = {tuple(plain(n)): f for f, ns in NAMES.items() for n in ns}
LONGEST_NAME = max(map(len, NAMED))


def _hits(w: list[str]) -> dict[int, list[int]]:
    """Places of each template's shingles; every shingle of the words is looked up once."""
    out: dict[int, list[int]] = {}
    for n in SIZES:
        for i in range(len(w) - n + 1):
            for k in INDEX.get(tuple(w[i : i + n]), ()):
                out.setdefault(k, []).append(i)
    return out


def agreement(w: list[str]) -> float:
    """Largest share of any template's shingles in the words."""
    return max((len({tuple(w[i : i + len(next(iter(need)))]) for i in at}) / len(need) for k, at in _hits(w).items() for need in (TEMPLATE_AT[k][2],)), default=0.0)


def named(w: list[str]) -> list[tuple[str, int, int, float]]:
    """Notices by name: a lead with `under` (or `by`, before a name that ends in licence), filling words, and a family's name; an identifier; or a paragraph that hardly holds more than a full name."""
    out = []
    i = 0
    while i < len(w):
        size = next((n for n in range(min(LONGEST_NAME, len(w) - i), 0, -1) if tuple(w[i : i + n]) in NAMED), 0)
        if not size:
            i += 1
            continue
        end = i + size
        full = w[end - 1] in ("license", "licence") or w[end : end + 1] in (["license"], ["licence"]) or (size > 2 and "license" in w[i:end])
        j = i - 1
        while j >= max(0, i - GAP) and w[j] in BETWEEN:
            j -= 1
        lead = j >= 1 and w[j - 1] in LEADS and (w[j] == "under" or (w[j] == "by" and full))
        lead = lead or (j >= 2 and w[j] == "under" and w[j - 1] in ("it", "them", "work", "code") and w[j - 2] in LEADS)
        if j >= 0 and w[j] == "spdx-license-identifier":
            out.append((NAMED[tuple(w[i:end])], j, end, 1.0))
        elif lead:
            out.append((NAMED[tuple(w[i:end])], j - 1, end, 1.0))
        elif full and len(w) <= HEADING and size > 1:
            out.append((NAMED[tuple(w[i:end])], i, end, 1.0))
        i = end
    return out


def places(w: list[str]) -> list[tuple[str, int, int, float]]:
    """(family, first word, word after the last, share of shingles) wherever a template agrees or a notice names a family; places of a family may overlap, of families only in a tie: the larger
    share goes before, as related licences share much of their wording."""
    out = named(w)
    for t, hits in _hits(w).items():
        family, _, need, reach = TEMPLATE_AT[t]
        n = len(next(iter(need)))
        if len({tuple(w[i : i + n]) for i in hits}) < CONFIRM * len(need):
            continue
        k = 0
        while k < len(hits):
            span = [i for i in hits[k:] if i + n <= hits[k] + reach]
            share = len({tuple(w[i : i + n]) for i in span}) / len(need)
            if share < CONFIRM:
                k += 1
                continue
            seen: set = set()
            for j, i in enumerate(span):  # a shingle that comes again begins another place
                x = tuple(w[i : i + n])
                if x in seen and len(seen) >= CONFIRM * len(need):
                    span = span[:j]
                    break
                seen.add(x)
            out.append((family, span[0], span[-1] + n, len(seen) / len(need)))
            k += len(span)
    kept: list[tuple[str, int, int, float]] = []
    for x in sorted(out, key=lambda x: (-x[3], x[1] - x[2])):
        if all(x[0] == y[0] or x[3] == y[3] or x[1] >= y[2] or y[1] >= x[2] for y in kept):
            kept.append(x)
    return kept


def drawn(r: random.Random, family: str) -> str:
    """A notice that names a family, in words drawn at random."""
    name = r.choice(NAMES[family])
    name = r.choice((name, name.title(), name.upper() if len(name) < 14 else name))
    lead, what = r.choice(LEADS), r.choice(("", "This project is", "This software is", "The code is", "All code is", "Code", "Content is", "This work is", "The library is"))
    between = r.choice(("the", "the terms of the", "a", "the terms and conditions of the", "", "the open source"))
    tail = "" if "licen" in name.lower() or r.random() < 0.4 else "license"
    alone = (f"{name} {tail}", f"SPDX-License-Identifier: {name}") if r.random() < 0.15 else ()
    return r.choice(alone or (f"{what} {lead} under {between} {name} {tail}",)).strip()


def variations(seed: int = 11, each: int = 200) -> tuple[list[str], list[int]]:
    """Templates with words dropped, doubled or drawn in around them, and notices by name in drawn words."""
    r = random.Random(seed)
    texts, y = [], []
    for k, family in enumerate(FAMILIES[1:], 1):
        for t in TEMPLATES[family]:
            for j in range(each):
                w = t.split()
                if j % 3 and len(w) > 5 and r.random() < 0.5:
                    del w[r.randrange(len(w))]
                if j % 2:
                    w = [r.choice(FILLER) for _ in range(r.randrange(8))] + w + [r.choice(FILLER) for _ in range(r.randrange(8))]
                texts.append(" ".join(w))
                y.append(k)
        for j in range(2 * each if family in NAMES else 0):
            w = drawn(r, family).split()
            if j % 2:
                w = [r.choice(FILLER) for _ in range(r.randrange(8))] + w + [r.choice(FILLER) for _ in range(r.randrange(8))]
            texts.append(" ".join(w))
            y.append(k)
    for _ in range(each * 4):  # the surrounding words alone say nothing
        texts.append(" ".join(r.choice(FILLER) for _ in range(r.randrange(3, 30))))
        y.append(0)
    return texts, y


def _negatives(batches):
    """Of each text up to EACH windows that hold no template, those with the lowest hashes."""
    for x in batches:
        p = Paragraphs(*utf8(x.column(0)))
        raw = memoryview(np.ascontiguousarray(p.data))
        bounds = np.searchsorted(p.row, np.arange(x.num_rows + 1))
        out = []
        for r in range(x.num_rows):
            own = sorted(range(bounds[r], bounds[r + 1]), key=lambda i: xxhash.xxh3_64_intdigest(raw[p.starts[p.lo[i]] : p.ends[p.hi[i] - 1]]))  # noqa: B023
            out += [t for t in map(p.text, own[:EACH]) if agreement(w := plain(t)) < 0.5 and not named(w)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])


def train(texts: DataFrame, negatives: int = NEGATIVES) -> Classifier:
    total = texts.count()
    share = min(1.0, SAMPLED / total) if total else 1.0
    some = texts.where(F.shiftrightunsigned(F.xxhash64("text"), 1) <= int(share * ((1 << 63) - 1024))).distinct()
    rows = some.mapInArrow(_negatives, "text string").distinct().toArrow()["text"].to_pylist()  # about SAMPLED * EACH windows at most
    rows = sorted(rows, key=lambda t: (xxhash.xxh3_64_intdigest(t.encode()), t))[:negatives]
    pos, y = variations()
    model = Classifier()
    model.fit(pos + rows, np.array(y + [0] * len(rows)))
    return model


def _notices(found: dict[tuple[int, str], list]) -> list[dict]:
    """Places of a family that overlap are one notice."""
    out = []
    for (line, family), spans in found.items():
        last = -1
        for start, end, probability, share in sorted(spans):
            if start < last:
                m = out[-1]
                m["probability"], m["agreement"] = max(m["probability"], probability), max(m["agreement"], share)
            else:
                out.append({"line": line, "at": start, "family": family, "probability": probability, "agreement": share})
            last = max(last, end)
    return [{k: v for k, v in m.items() if k != "at"} for m in sorted(out, key=lambda m: (m["line"], m["at"], m["family"]))]


def _scan(model):
    def run(batches):
        for x in batches:
            data, off = utf8(x.column(1))
            p = Paragraphs(data, off)
            prob = model.value.probabilities(p)
            sure = 1 - prob[:, 0] if len(prob) else np.zeros(0)
            found: dict[int, dict] = {}
            for i in np.flatnonzero(sure >= CONFIDENT).tolist():
                w, start, end = p.region(i)
                for family, u, v, share in places(w):
                    if start[u] < p.ends[p.hi[i] - 1] and end[v - 1] > p.starts[p.lo[i]]:
                        found.setdefault(int(p.row[i]), {}).setdefault((p.line(p.row[i], start[u]), family), []).append((int(start[u]), int(end[v - 1]), float(sure[i]), share))
            marks = [_notices(found.get(r, {})) for r in range(x.num_rows)]
            struct = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("agreement", pa.float64())]))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(p.of_row.astype(np.int64)), pa.array(marks, struct)], names=["doc_id", "n_paragraphs", "notices"])

    return run


def license_scan(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """Per row: n_paragraphs, notices (line, family, probability, agreement; in order of place) and families."""
    spark = docs.sparkSession
    tune(spark)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(some.select("text"), negatives))
    out = some.mapInArrow(_scan(model), "doc_id long, n_paragraphs long, notices array<struct<line:int,family:string,probability:double,agreement:double>>")
    return out.withColumn("families", F.array_sort(F.array_distinct(F.transform("notices", lambda m: m["family"]))))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
