"""Licence scan: a trained paragraph classifier whose finds templates confirm.

A paragraph is a line with a word.  Its word unigrams and bigrams, hashed,
are the sparse features of a multinomial logistic regression over licence
families and an unknown class, trained on varied template notices and on a
bounded sample of the corpus' own paragraphs, and calibrated on the part held
back.  What it finds is compared with the family's templates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import bounded_batches, written
from tallyweave.llm.words import blocks, buffers, mix, split_words

_U = np.uint64
FEATURE_BITS = 16
#: Paragraphs of the corpus that train and calibrate the unknown class, at most.
SAMPLE_PARAGRAPHS = 4000
LEAST_SIMILARITY = 0.6
SCHEMA = "doc_id bigint, paragraph int, family string, probability double, similarity double, confirmed boolean"

#: Public licence notices by family.
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache 2.0 License.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL, version 2 or later.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
}
UNKNOWN = "unknown"


def _byte_map() -> np.ndarray:
    """Lower-case letters, hyphens and bytes beyond ASCII stay, digits become 0, a line end stays, the rest is a space."""
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x30:0x3A] = 0x30
    table[0x2D], table[0x0A] = 0x2D, 0x0A
    table[0x80:] = np.arange(0x80, 0x100)
    return table


class Paragraphs:
    """Features of the lines with a word of a block: ``feature[first[i]:first[i + 1]]`` are those of paragraph i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _byte_map()[data]
        breaks = np.flatnonzero(data == 0x0A)
        starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        starts = starts[starts < len(data)]
        words = split_words(data, np.append(starts, len(data)))
        used = np.flatnonzero(words.count)
        self.starts = starts[used]
        self.ends = np.append(starts[1:], len(data))[used]
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        line = np.searchsorted(starts, offsets[:-1])
        self.number = used - line[self.row]
        n, count = len(words.start), words.count[used]
        mask = _U((1 << FEATURE_BITS) - 1)
        single = (mix(words.hash) & mask).astype(np.int32)
        pair = (mix(words.hash[:-1] * _U(3) + mix(words.hash[1:])) & mask).astype(np.int32) if n else single
        # Each word gives its unigram, and the bigram with its successor if that is in the line.
        both = np.empty(2 * n, np.int32)
        both[::2] = single
        both[1::2] = np.append(pair, 0) if n else pair
        keep = np.ones(2 * n, bool)
        last = np.cumsum(count) - 1
        keep[2 * last + 1] = False
        # A feature counts once in a paragraph.
        owner = np.repeat(np.arange(len(used)), 2 * count - 1)
        pairs = np.unique(owner << FEATURE_BITS | both[keep])
        self.feature = (pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
        self.first = np.searchsorted(pairs >> FEATURE_BITS, np.arange(len(used) + 1))


def paragraphs_of(texts: list[str]) -> Paragraphs:
    data, offsets = buffers(pa.array([t.replace("\n", " ") for t in texts]))
    return Paragraphs(data, offsets)


def logits(p: Paragraphs, weights: np.ndarray) -> np.ndarray:
    """Linear scores [paragraph, class]; distinct features count by one over the root of their number; the last weight row is the bias."""
    n = np.diff(p.first)
    total = np.add.reduceat(weights[p.feature], p.first[:-1], axis=0) if len(n) else np.zeros((0, weights.shape[1]))
    return total / np.sqrt(n)[:, None] + weights[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(p: Paragraphs, label: np.ndarray, classes: int, rounds: int = 150, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression by full-batch gradient descent with momentum; classes weigh alike."""
    weights, moved = np.zeros(((1 << FEATURE_BITS) + 1, classes)), 0.0
    n = np.diff(p.first)
    used, compact = np.unique(p.feature, return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    share = 1 / np.bincount(label, minlength=classes)[label] / classes
    local = np.zeros((len(used) + 1, classes))
    for _ in range(rounds):
        total = np.add.reduceat(local[compact], p.first[:-1], axis=0) / np.sqrt(n)[:, None] + local[-1]
        error = softmax(total)
        error[np.arange(len(label)), label] -= 1
        error *= share[:, None]
        scaled = (error / np.sqrt(n)[:, None])[owner]
        slope = np.vstack([np.column_stack([np.bincount(compact, scaled[:, c], len(used)) for c in range(classes)]), error.sum(0)])
        moved = 0.9 * moved - rate * (slope + decay * local)
        local = local + moved
    weights[used], weights[-1] = local[:-1], local[-1]
    return weights


class LicenceModel:
    """Families, weights, temperature and the least probability of a find."""

    def __init__(self, families: list[str], weights: np.ndarray, temperature: float, least: float):
        self.families, self.weights, self.temperature, self.least = families, weights, temperature, least
        self.templates = {f: [set(t.feature.tolist()) for t in (paragraphs_of([x]) for x in TEMPLATES[f])] for f in families if f in TEMPLATES}

    def probabilities(self, p: Paragraphs) -> np.ndarray:
        return softmax(logits(p, self.weights) / self.temperature)

    def similarity(self, family: str, features: set[int]) -> float:
        """The greatest share of a template's n-grams in the paragraph, or of a long paragraph's in the template."""
        best = 0.0
        for t in self.templates[family]:
            common = len(t & features)
            best = max(best, common / len(t), common / len(features) if len(features) >= 8 else 0.0)
        return best


def varied_notices(seed: int, each: int, fillers: list[str]) -> tuple[list[str], list[str]]:
    """Template notices with words left out, cut, or set among words of the corpus; (texts, families)."""
    random = np.random.Generator(np.random.Philox(seed))
    texts, families = [], []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            for k in range(each):
                own = [w for w in words if k == 0 or random.random() > 0.06]
                if k % 3 == 1 and fillers:
                    filler = fillers[int(random.integers(len(fillers)))].split()[: int(random.integers(1, 7))]
                    own = filler + own if random.random() < 0.5 else own + filler
                texts.append(" ".join(own or words))
                families.append(family)
    return texts, families


def fit_licences(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_PARAGRAPHS, seed: int = 1) -> LicenceModel:
    """Train and calibrate on template notices and at most ``most`` sampled paragraphs of ``docs``.

    Sampled paragraphs that a template matches don't train the unknown class.
    The temperature is the one of least loss on the held-back half, and a find
    needs a probability that at most one in a thousand of the held-back
    unknown paragraphs reaches (one half at least).
    """
    lines = docs.select(F.explode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line")).where(F.col("line").rlike(r"\S"))
    lines = lines.select(F.xxhash64("line", F.lit(seed)).alias("h"), "line")
    # Copies of a line count once.  A hash threshold from the number of distinct lines: about 1.5 ``most`` hashes are ranked, however many tasks there are.
    hashes = written(lines.select("h").distinct(), "lines")
    n_lines = hashes.count()
    rare = F.pmod("h", F.lit(1 << 31)) < F.lit(min(1 << 31, math.ceil((1 << 31) * 1.5 * most / max(n_lines, 1))))
    picks = hashes.where(rare).orderBy("h").limit(most)
    picked = lines.join(F.broadcast(picks), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    sample = [r.line for r in sorted(picked.collect(), key=lambda r: r.h)]
    families = [*TEMPLATES, UNKNOWN]
    known = LicenceModel(families, np.zeros((1, 1)), 1.0, 0.5)
    plain = []
    for line in sample:
        p = paragraphs_of([line])
        if len(p.feature) and max(known.similarity(f, set(p.feature.tolist())) for f in TEMPLATES) < 0.4:
            plain.append(line)
    texts, names = varied_notices(seed, 16, plain)
    # Ordinary sentences about licences teach the unknown class too, whatever the corpus holds.
    plain += ["The license of the driver was renewed in the public office.", "A general version of the work is free to the public.", "under the", "version 3"] * 4
    texts, names = texts + plain, names + [UNKNOWN] * len(plain)
    label = np.array([families.index(n) for n in names])
    p = paragraphs_of(texts)
    label = label[p.row]
    held = np.arange(len(label)) % 2 == 1

    def part(keep: np.ndarray) -> Paragraphs:
        return paragraphs_of([texts[r] for r in p.row[keep]])

    weights = train(part(~held), label[~held], len(families))
    scores = logits(part(held), weights)
    truth = label[held]
    loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    found = 1 - softmax(scores / temperature)[truth == len(families) - 1][:, -1]
    least = max(0.5, float(np.quantile(found, 0.999)) if len(found) else 0.5)
    return LicenceModel(families, weights.astype(np.float32), temperature, min(least, 0.99))


def licence_finds(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed): a row per paragraph that the classifier gives to a family.

    Paragraphs are a text's lines, numbered from 0, wordless ones counted;
    ``confirmed`` says that a template of the family agrees.  Null, empty and
    wordless texts give no rows, repeated rows repeat their finds, other
    columns are ignored, an empty table gives no rows.  No shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    fitted = model or fit_licences(docs, text_col)
    shared = spark.sparkContext.broadcast((fitted.families, fitted.weights, fitted.temperature, fitted.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = LicenceModel(*shared.value)
        for batch in batches:
            data, offsets = buffers(batch.column(1).cast(pa.large_string()))
            for low, high in blocks(offsets, 1 << 20):
                at = offsets[low : high + 1]
                p = Paragraphs(data[at[0] : at[-1]], at - at[0])
                if not len(p.row):
                    continue
                chance = fitted.probabilities(p)
                best = chance[:, :-1].argmax(1)
                found = np.flatnonzero((chance[:, :-1].max(1) >= fitted.least))
                names = [fitted.families[b] for b in best[found]]
                alike = [fitted.similarity(n, set(p.feature[p.first[i] : p.first[i + 1]].tolist())) for n, i in zip(names, found.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low).take(pa.array(p.row[found])),
                        pa.array(p.number[found].astype(np.int32)),
                        pa.array(names, pa.string()),
                        pa.array(chance[found, best[found]].astype(float)),
                        pa.array(alike, pa.float64()),
                        pc.greater_equal(pa.array(alike, pa.float64()), LEAST_SIMILARITY),
                    ],
                    names=["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SCHEMA)
