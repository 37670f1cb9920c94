"""License scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, bounded_sample, texts_of

#: Short public notices by licence family. Fixed values.
TEMPLATES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal public domain dedication.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "Copyright, all rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ),
}
UNKNOWN = "unknown"
BINS = 4096
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Sentences about rights that grant none, as labelled unknowns. Fixed values.
_OTHER = (
    "A driving license is required for this position.",
    "He asked permission to leave the room.",
    "The warranty covers parts and labour for two years.",
    "Copyright law differs between countries.",
    "The general public was invited to the opening.",
    "She attended a course on software licensing.",
    "The terms of the agreement were never published.",
    "This work was finished under difficult conditions.",
)


def words_of(line: bytes) -> list[bytes]:
    return line.translate(_FOLD).split()


def grams_of(words: list[bytes], longest: int = 3) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bins_of(words: list[bytes]) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(g) % BINS for g in grams_of(words)], dtype=np.int64))


def pairs_of(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False))


def blocks_of(raw: bytes) -> Iterator[list[tuple[int, int]]]:
    """The paragraphs of a text: runs of lines that aren't blank, as (start, end) byte ranges of their lines."""
    block, at = [], 0
    for line in raw.split(b"\n"):
        if line.strip():
            block.append((at, at + len(line)))
        elif block:
            yield block
            block = []
        at += len(line) + 1
    if block:
        yield block


@dataclass(frozen=True)
class LicenseModel:
    """weights: bins x classes (the last is unknown), mostly zero; heat divides the scores before the softmax.

    A run of lines is a licence if its class's probability is at least `least` and its word pairs agree with that
    family's templates: at least `share` of them are in these, or, for a single line, `share` of some template's pairs
    are in the line."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    heat: float
    triggers: frozenset
    pairs: dict
    least: float = 0.5
    share: float = 0.6

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        b = bins_of(words)
        z = (self.weights[b].sum(axis=0) / max(1, len(b)) ** 0.5 + self.bias) / self.heat
        e = np.exp(z - z.max())
        return e / e.sum()

    def confirm(self, name: str, words: list[bytes], inside: bool) -> float:
        """Share of the word pairs that are in the family's templates; with `inside`, or of a template's pairs that
        are in the words, if that is more."""
        own, of = pairs_of(words), self.pairs[name]
        if not own:
            return 0.0
        whole = len(own & set().union(*of)) / len(own)
        return max(whole, *(len(own & p) / len(p) for p in of)) if inside else whole

    def judge(self, words: list[bytes], inside: bool) -> tuple[str, float] | None:
        p = self.probabilities(words)
        k = int(p.argmax())
        if k == len(self.names) - 1 or p[k] < self.least or self.confirm(self.names[k], words, inside) < self.share:
            return None
        return self.names[k], float(p[k])

    def may(self, words: list[bytes], inside: bool) -> bool:
        """Whether confirm() can reach `share` for any family, counted over all templates' pairs together."""
        own = pairs_of(words)
        hits = len(own & self.triggers)
        return hits > 0 and (hits >= self.share * len(own) or inside and hits >= self.share * min(len(p) for of in self.pairs.values() for p in of))

    def runs(self, words: list[list[bytes]], gate: bool) -> list[tuple[int, int, str, float]]:
        """(first line, end, family, probability) within a block: the whole block if it is a licence; or else the
        longest runs of lines of which half the pairs are templates', where they are; or else single lines."""

        def found(i: int, j: int, inside: bool) -> tuple[str, float] | None:
            every = [w for line in words[i:j] for w in line]
            return self.judge(every, inside) if not gate or self.may(every, inside) else None

        if (whole := found(0, len(words), len(words) == 1)) or len(words) == 1:
            return [(0, len(words), *whole)] if whole else []
        out, i = [], 0
        around = zip([[], *words], words, [*words[1:], []], strict=False)  # a line with the words before and after it
        like = [2 * len(own & self.triggers) >= len(own) > 0 for own in (pairs_of([*a[-1:], *w, *b[:1]]) for a, w, b in around)]
        while i < len(words):
            j = i + 1
            while like[i] and j < len(words) and like[j]:
                j += 1
            if j > i + 1 and (run := found(i, j, False)):
                out.append((i, j, *run))
            else:
                out += [(k, k + 1, *one) for k in range(i, j) if (one := found(k, k + 1, True))]
            i = j
        return out

    def scan(self, raw: bytes, gate: bool = True) -> tuple[int, list[tuple[str, int, int, float]]]:
        """Number of paragraphs (runs of lines that aren't blank), and (family, start, end, probability) in code points;
        adjacent finds of a family in a paragraph are one span with the smallest probability. Without the gate
        every paragraph and line is scored; the result is the same."""
        n, out, at, chars = 0, [], 0, 0
        for block in blocks_of(raw):
            n += 1
            words = words_of(raw[block[0][0] : block[-1][1]])
            if gate and self.triggers.isdisjoint(zip(words, words[1:], strict=False)):
                continue
            last = -1
            for i, j, name, p in self.runs([words_of(raw[s:e]) for s, e in block], gate):
                (start, _), (_, end) = block[i], block[j - 1]
                chars += len(raw[at:start].decode(errors="replace"))
                size = len(raw[start:end].decode(errors="replace"))
                if last == i and out[-1][0] == name:
                    out[-1] = (name, out[-1][1], chars + size, min(out[-1][3], p))
                else:
                    out.append((name, chars, chars + size, p))
                last, at, chars = j, end, chars + size
        return n, out


def noisy(text: str, rng: random.Random) -> str:
    """A labelled variant by rule: a run of at least two thirds of the words, one in twenty left out."""
    words = text.split()
    n = rng.randint(max(1, len(words) * 2 // 3), len(words))
    s = rng.randint(0, len(words) - n)
    return " ".join(w for w in words[s : s + n] if rng.random() > 0.05 or n < 6)


def train_logistic(x: np.ndarray, y: np.ndarray, classes: int, sparse: float = 2e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with an L1 penalty, by accelerated proximal steps."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    v, c = w.copy(), b.copy()
    target = np.eye(classes, dtype=np.float32)[y]
    share = 1 / np.maximum(1, np.bincount(y, minlength=classes))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    step = 2.0
    for t in range(rounds):
        z = x @ v + c
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - target) * share
        w2 = v - step * (x.T @ g)
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - step * sparse)
        b2 = c - step * g.sum(0)
        v, c = w2 + t / (t + 3) * (w2 - w), b2 + t / (t + 3) * (b2 - b)
        w, b = w2, b2
    return w, b


def fit(unknown: list[str], seed: int = 3, each: int = 60) -> LicenseModel:
    """unknown: paragraphs of the corpus that hold no licence. A fifth of the sample, left out of the regression,
    sets the heat by its likelihood."""
    rng = random.Random(seed)
    names = [*sorted(TEMPLATES), UNKNOWN]
    rows = [(t if k == 0 else noisy(t, rng), names.index(f)) for f, texts in sorted(TEMPLATES.items()) for t in texts for k in range(each // len(texts))]
    rows += [(t if k == 0 else noisy(t, rng), len(names) - 1) for t in _OTHER for k in range(6)] + [(t, len(names) - 1) for t in unknown]
    x = np.zeros((len(rows), BINS), np.float32)
    for i, (t, _) in enumerate(rows):
        b = bins_of(words_of(t.encode()))
        x[i, b] = 1 / max(1, len(b)) ** 0.5
    y = np.array([k for _, k in rows])
    held = np.array([zlib.crc32(t.encode()) % 5 == 0 for t, _ in rows])
    w, b = train_logistic(x[~held], y[~held], len(names))
    z = x[held] @ w + b

    def loss(h: float) -> float:
        s = z / h - (z / h).max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[held]]).mean())

    heat = min((0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss) if held.any() else 1.0
    pairs = {f: [pairs_of(words_of(t.encode())) for t in texts] for f, texts in TEMPLATES.items()}
    triggers = frozenset().union(*(p for of in pairs.values() for p in of))
    return LicenseModel(names, w, b, heat, triggers, pairs)


def train(docs: DataFrame, max_train_docs: int = 800, parts_per_doc: int = 3, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Unknowns come from at most max_train_docs documents, at most parts_per_doc whole lines and as many whole
    paragraphs of each, chosen by their hash; those in which half the word pairs of some line are a template's are not
    unknown."""
    pairs = {p for texts in TEMPLATES.values() for t in texts for p in pairs_of(words_of(t.encode()))}

    def like(line: bytes) -> bool:
        own = pairs_of(words_of(line))
        return bool(own) and 2 * len(own & pairs) >= len(own)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in as_bytes(batch.column(1)):
                blocks = [raw[b[0][0] : b[-1][1]] for b in blocks_of(raw) if not any(like(raw[s:e]) for s, e in b)]
                lines = {x for x in raw.split(b"\n") if x.strip() and not like(x)}
                for some in (set(blocks), lines):
                    out += [x.decode() for x in sorted(some, key=zlib.crc32)[:parts_per_doc]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["part"])

    got = bounded_sample(texts_of(docs, id_col, text_col), max_train_docs, salt=9).mapInArrow(parts, "part string").collect()
    return fit(sorted({r.part for r in got}))


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_paragraphs and licenses, an array of (family, start, end,
    probability), offsets in code points.

    A paragraph is a run of lines that aren't blank, so a wrapped notice is one; where it isn't a licence as a whole,
    the lines in it that read like notices are judged by themselves. Null or empty texts have none; repeated rows give
    repeated results; null ids stay null; other columns are ignored; whole texts are read. What has too few word pairs
    of the templates to be confirmed, whatever the classifier says, isn't scored; this takes nothing away. Without a
    model one is trained, see train()."""
    model = model or train(docs, id_col=id_col, text_col=text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            made = [model.scan(raw) for raw in as_bytes(batch.column(1))]
            spans = [[{"family": f, "start": s, "end": e, "probability": p} for f, s, e, p in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array(spans, kind)], names=["doc_id", "n_paragraphs", "licenses"])

    return texts_of(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_paragraphs long, licenses array<struct<family:string,start:long,end:long,probability:double>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("licenses.family")), ",").alias("families"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )
