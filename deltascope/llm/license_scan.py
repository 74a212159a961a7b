"""Licence families of paragraphs, with DataFrame functions only on the data path.

A softmax regression over word unigrams and bigrams tells licence families and an
unknown class apart.  It is trained on the driver, on notices made from the
templates below with varied frames and on ordinary prose; an L1 penalty makes it a
sparse table of some hundred n-grams, all of which are used.  Its temperature is
calibrated on notices and prose written for that, which no generator made.  A
paragraph whose family is likelier than ``LEAST_CHANCE`` counts as found only when it
also holds ``LEAST_COVER`` of the distinct words of one of the family's templates.

A paragraph ends at a blank line or where a line ends in closing punctuation; one
of several lines is read whole, so that a wrapped notice is seen, and line by line.

Cases: null and empty texts have no paragraphs and the family "none"; equal chances
go to the first family by name; repeated rows are rows of their own (they share the
row hash of doc_id and text); an empty table gives an empty result; further columns
are ignored.

Scale: paragraphs are exploded into n-grams and meet the model in a broadcast join
(its size is fixed); only hits are summed, by row and paragraph, with map-side
combine, so no text is shuffled and a licence that is everywhere is no hot key.  Paragraphs
that lack every word of which a found one must have one (``anchors``) aren't split.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c

LEAST_CHANCE = 0.6
LEAST_COVER = 0.7
#: Weight of the L1 penalty, which sets to zero what tells no family apart.
SPARSITY = 2e-4
#: Where a paragraph ends.
_BREAK = r"(?<=[.!?:;][\"')\]]{0,2})[ \t\r]*\n\s*|\n[ \t\r]*\n\s*"
UNKNOWN = "unknown"

#: Short notices by which licences are named in texts.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["licensed under the gnu affero general public license version 3"],
    "apache-2.0": ["licensed under the apache license version 2.0", "released under the apache 2.0 license"],
    "bsd": ["licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "gpl": ["licensed under the gnu general public license version 3", "free software under the terms of the gnu general public license"],
    "lgpl": ["licensed under the gnu lesser general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy"],
    "mpl": ["subject to the terms of the mozilla public license version 2.0"],
    "proprietary": ["all rights reserved", "unauthorized copying of this file is strictly prohibited"],
    "public-domain": ["dedicated to the public domain under cc0 1.0", "released into the public domain"],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
_FRAMES = (["", "this work is", "this file is", "this project is", "the code is", "copyright 2020 the authors", "content", "software"], ["", "see the license file", "for details", "and may be used freely", "you may obtain a copy", "no warranty"])
_PROSE = """the driver lost his license last year and the public was not amused
general rules for the work of the commons were read under the old version of the law
she released the birds into the domain of the king and reserved all seats
free software is a matter of liberty and of rights and of many files
this text is under review and the terms of the contract are subject to change
permission to land was granted by the person in charge of the tower
a license to kill and other stories by the author of all rights and wrongs
copyright law is a creative field said the attribution clerk
in the beginning there was the word and the word was in the file
apache helicopters flew over the mozilla bay while mit students watched
redistribution of wealth is a common and international theme
und der die das ist nicht unter einer lizenz der welt
la licence est dans le domaine de la commune et les droits sont libres
el permiso de la obra es del autor y de todos los derechos""".split("\n")


#: Paragraphs that the temperature is calibrated on.
_CALIBRATION = [
    ("agpl", "You can redistribute it and modify it under the GNU Affero General Public License, version 3, as published by the foundation."),
    ("apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("apache-2.0", "SPDX-License-Identifier: Apache License 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Distributed under the terms of the BSD 3 Clause License."),
    ("cc-by", "Except where noted, content on this site is under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "The photographs may be shared under CC BY-NC 4.0 for private purposes."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 International License; additional terms may apply."),
    ("gpl", "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 3 or later."),
    ("gpl", "GNU General Public License v3 applies to all of the above."),
    ("lgpl", "The library is distributed under the GNU Lesser General Public License, version 3."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in it without restriction."),
    ("mit", "Code samples are available under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "Copyright 1999 Example Corporation. All rights reserved worldwide."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("public-domain", "To the extent possible the author has dedicated this work to the public domain under CC0 1.0."),
    ("public-domain", "The maps were released into the public domain by their makers."),
    *(
        (UNKNOWN, x)
        for x in (
            "The committee met on Tuesday to discuss the budget of the new library.",
            "A driving license must be renewed every ten years in most countries.",
            "She read law at the university and later wrote about human rights.",
            "Rain is expected in the north, with sunny spells towards the evening.",
            "The museum is open to the public from nine to five, except on Mondays.",
            "Version 2.0 of the report corrects several errors in the tables.",
            "Free admission for children under twelve; no tickets are needed.",
            "The general assembly adopted the resolution by a large majority.",
            "Das Haus steht seit hundert Jahren leer, und niemand will es kaufen.",
            "Les enfants jouent dans le jardin pendant que leur mère prépare le dîner.",
            "El tren llega a las ocho y sale de nuevo a las nueve y cuarto.",
            "Mix the flour with the eggs, add a pinch of salt and leave it to rest.",
            "Copy the file to the other folder and restart the program.",
            "The international trade in coffee grew by four percent last year.",
            "He asked for permission to leave, which was granted at once.",
            "All seats are reserved, so please arrive before the doors close.",
        )
    ),
]


def _tokens(text: str) -> list[str]:
    return [x for x in re.split(r"[^0-9a-z.]+|\.(?![0-9])", text.lower()) if x]


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in itertools.pairwise(words))}


def _examples(seed: int, each: int) -> tuple[list[set[str]], list[int]]:
    """Notices in varied frames, with dropped or foreign words, and prose of the unknown class."""
    rng = random.Random(seed)
    prose = [w for line in _PROSE for w in line.split()]
    texts, labels = [], []
    for k, family in enumerate(FAMILIES):
        for _ in range(each * (6 if family == UNKNOWN else 1)):
            if family == UNKNOWN:
                words = rng.choice(_PROSE).split() if rng.random() < 0.5 else rng.choices(prose, k=rng.randint(2, 25))
                if rng.random() < 0.2:  # the frame of a notice without a licence
                    words = f"{rng.choice(_FRAMES[0])} {rng.choice(['licensed under the', 'released under the', 'under the terms of the'])} {' '.join(words[:3])}".split()
            else:
                words = f"{rng.choice(_FRAMES[0])} {rng.choice(TEMPLATES[family])} {rng.choice(_FRAMES[1])}".split()
                if rng.random() < 0.3:
                    at = rng.randrange(len(words) + 1)
                    words[at:at] = rng.choices(prose, k=rng.randint(1, 6))
            texts.append(_grams(_tokens(" ".join(words))))
            labels.append(k)
    return texts, labels


def _matrix(texts: list[set[str]], names: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(names)), np.float32)
    for i, t in enumerate(texts):
        out[i, [names[x] for x in t if x in names]] = 1
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by Adam, each step followed by the shrinkage of the L1 penalty."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    w = np.zeros((x.shape[1], y.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = x.T @ ((y - _softmax(x @ w)) / len(x)).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - SPARSITY * 10, 0)
    return w[:-1], w[-1]


@lru_cache(1)
def model() -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Weights of each n-gram that has any, bias, and temperature."""
    texts, labels = _examples(3, 120)
    counts = Counter(x for t in texts for x in t)
    names = {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= 3))}
    w, bias = _fit(_matrix(texts, names), np.eye(len(FAMILIES))[labels])
    held = [_grams(_tokens(x)) for _, x in _CALIBRATION]
    truth = [FAMILIES.index(f) for f, _ in _CALIBRATION]
    raw = _matrix(held, names) @ w + bias
    temperature = min((x / 10 for x in range(1, 60)), key=lambda t: -np.log(_softmax(raw / t)[np.arange(len(held)), truth] + 1e-12).mean())
    return {x: np.round(w[i], 6) for x, i in names.items() if w[i].any()}, np.round(bias, 6), temperature


def _model_table(spark: SparkSession) -> DataFrame:
    """gram, weight of each family, and the templates that have it as a word."""
    weights, _, _ = model()
    templates = [set(_tokens(t)) for ts in TEMPLATES.values() for t in ts]
    words = {w for t in templates for w in t}
    rows = [(g, weights[g].tolist() if g in weights else [0.0] * len(FAMILIES), [int(g in t) for t in templates]) for g in sorted({*weights, *words})]
    return spark.createDataFrame(rows, "gram string, w array<double>, t array<int>")


def _split(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), r"[^0-9a-z.]+|\.(?![0-9])"), lambda x: x != "")


@lru_cache(1)
def anchors() -> list[str]:
    """Words of which a paragraph must have one to be found.

    Of each template so many that the rest alone is under LEAST_COVER of it; those
    that templates share first, as they make the list short.
    """
    templates = [set(_tokens(t)) for ts in TEMPLATES.values() for t in ts]
    shared = Counter(w for t in templates for w in t)
    out: set[str] = set()
    for t in templates:
        most_missing = len(t) - math.ceil(LEAST_COVER * len(t) - 1e-9)
        out |= set(sorted(t, key=lambda w: (len(w) < 5, -shared[w], -len(w), w))[: most_missing + 1])
    return sorted(out)


def _may_hold(text: Column) -> Column:
    """Whether a text has an anchor anywhere: a test without splitting it."""
    lower = F.lower(text)
    return functools.reduce(lambda a, b: a | b, (lower.contains(w) for w in anchors()))


def paragraphs(docs: DataFrame, findable: bool = False) -> DataFrame:
    """doc_id, row, paragraph, part, family, chance and found, of paragraphs with an n-gram of the model.

    Part 0 is the whole paragraph; one of several lines also has a part for each.
    With ``findable`` those without an anchor are left out, none of which is found.
    """
    spark = docs.sparkSession
    _, bias, temperature = model()
    table = _model_table(spark)
    owner = [(f, len(set(_tokens(t)))) for f, ts in TEMPLATES.items() for t in ts]
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("copy"))
    if findable:
        docs = docs.where(_may_hold(F.col("text")))
    blocks = docs.select("doc_id", "copy", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", _BREAK)).alias("paragraph", "whole"))
    parts = F.when(F.col("whole").contains("\n"), F.concat(F.array("whole"), F.split("whole", "\n"))).otherwise(F.array("whole"))
    lines = blocks.select("doc_id", "copy", "row", "paragraph", F.posexplode(parts).alias("part", "line"))
    place = ["doc_id", "copy", "row", "paragraph", "part"]
    if findable:
        lines = lines.where(_may_hold(F.col("line")))
    words = lines.select(*place, _split(F.col("line")).alias("x")).where(F.size("x") > 0)
    grams = F.array_distinct(F.concat("x", F.transform(F.slice("x", 2, F.size("x")), lambda w, i: F.concat_ws(" ", F.element_at("x", i + 1), w))))
    hits = words.select(*place, F.explode(grams).alias("gram")).join(F.broadcast(table), "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(len(FAMILIES))] + [F.sum(F.col("t")[k]).alias(f"t{k}") for k in range(len(owner))]
    summed = hits.groupBy(*place).agg(*sums)
    logits = [(F.col(f"w{k}") + F.lit(float(bias[k]))) / F.lit(temperature) for k in range(len(FAMILIES))]
    top = summed.select("doc_id", "row", "paragraph", "part", F.array(*logits).alias("z"), *(F.col(f"t{k}") for k in range(len(owner))))
    top = top.withColumn("best", F.array_max("z"))
    chance = F.expr("1 / aggregate(z, 0D, (a, x) -> a + exp(x - best))")
    index = F.array_position("z", F.col("best")).cast("int")
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), index)
    covers = [F.when((family == f) & (F.col(f"t{k}") >= LEAST_COVER * n), True).otherwise(False) for k, (f, n) in enumerate(owner)]
    confirmed = covers[0]
    for x in covers[1:]:
        confirmed = confirmed | x
    out = top.select("doc_id", "row", "paragraph", "part", family.alias("family"), chance.alias("chance"), confirmed.alias("confirmed"))
    return out.withColumn("found", (F.col("family") != UNKNOWN) & (F.col("chance") >= LEAST_CHANCE) & F.col("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """Each document's surest family ("none" without), chance, notices and all families found."""
    found = paragraphs(docs, findable=True).where("found").groupBy("doc_id", "row")
    # a row may come repeatedly: its paragraphs count once
    best = F.max_by(F.struct("family", "chance"), F.struct(F.round("chance", 6), -F.col("paragraph"), -F.col("part"))).alias("best")
    found = found.agg(best, F.countDistinct("paragraph").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    found = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "best", "n", "families")
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["row"] == F.col("r")), "left")
    return joined.select("doc_id", F.coalesce("best.family", F.lit("none")).alias("family"), F.coalesce("best.chance", F.lit(0.0)).alias("chance"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(c.table(spark, sf_dir, "documents"))
