"""Licence scan: a trained paragraph classifier, calibrated, with template comparison; DataFrame functions only.

Paragraphs are lines of a text, and stretches that run over a line break within a run of lines that aren't blank: around
each break the ``REACH`` words before it in its line and after it in the run are searched for stretches that hold most of the
words of a template; these are classified and confirmed as lines are. The classifier is a sparse multinomial logistic regression over word 1- to 3-grams,
fitted by proximal gradient steps on the fixed notices below (and on counter-examples that use their words
otherwise); its L1 penalty leaves a short table of weights. Class 0 is "unknown"; a temperature chosen on held-out
variants calibrates the chances. A line gets a family if its chance is over one half, and is confirmed if it holds
most of the words of one of that family's templates. Training sees only the notices below, so it is small, fixed and
done once on the driver; scoring is SQL: explode, a join with the weight table (its size is fixed by the notices) and sums.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Wording of common public licence notices, by family.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL version 2 or later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
# Sentences that use the notices' words for other things.
OTHERS = [
    "You need a driving license to rent a car.",
    "The license plate was stolen from the file.",
    "He asked for permission to leave and permission was granted.",
    "The public library is free of charge for any person.",
    "The software version was released under great pressure.",
    "She works under the general manager of the foundation.",
    "This work is in the public interest.",
    "The table was reserved for the rights group.",
    "All seats are reserved.",
    "Copyright law is taught in the second year.",
    "The terms of the agreement are published by the court.",
    "The source of the river is in the public park.",
    "You may not use this door.",
    "A copy of the report was distributed to all members.",
    "The author has related work in binary systems.",
    "Redistribution of income is a common aim of taxation.",
    "The universal declaration of human rights",
    "They attribute the work to an international team.",
    "The commercial license of the pub was not renewed.",
    "The Apache helicopter was modified in version two.",
    "MIT is a university in Cambridge.",
    "The gnu is an animal of the general plains.",
    "Creative people share alike.",
    "The Mozilla browser was updated.",
]
FUNCTION_WORDS = set("a all an and any are as at be by for from has in is it its may no not of on or our that the this to was we will with you your".split())

L1, STEPS, CERTAIN, CONFIRMED = 2e-4, 600, 0.5, 0.6
#: Words on each side of a line break; no notice above has more.
REACH = 40


def words(line: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", line.lower()).split()


def grams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def variants(w: list[str], n: int = 6) -> list[list[str]]:
    """Fixed disturbances: parts of a notice, notices with a word missing, notices among other words."""
    out = [w, ["x1"] + w + ["x2", "x3"]]
    for i in range(n):
        j = (i * 7 + len(w)) % len(w)
        out.append(w[:j] + w[j + 1 :] if len(w) > 3 else w)
    return out


class Model:
    """classes[0] is unknown; weights: n-gram -> a value for each class; bias; temperature."""

    def __init__(self):
        self.classes = ["unknown", *NOTICES]
        vocabulary = sorted({g for texts in NOTICES.values() for t in texts for g in grams(words(t)) if not set(g.split()) <= FUNCTION_WORDS})
        at = {g: i for i, g in enumerate(vocabulary)}
        rows, y, hold = [], [], []
        examples = [(c, t) for c, texts in enumerate(NOTICES.values(), 1) for t in texts] + [(0, t) for t in OTHERS]
        for c, t in examples:
            for i, v in enumerate(variants(words(t))):
                rows.append([at[g] for g in grams(v) if g in at])
                y.append(c)
                hold.append(i % 4 == 3)
        for _ in range(60):  # lines without a known word
            rows.append([])
            y.append(0)
            hold.append(False)
        x = np.zeros((len(rows), len(vocabulary)))
        for i, r in enumerate(rows):
            x[i, r] = 1
        y, hold = np.array(y), np.array(hold)
        target = np.eye(len(self.classes))[y]
        w, b = np.zeros((len(vocabulary), len(self.classes))), np.zeros(len(self.classes))
        xt, tt = x[~hold], target[~hold]
        rate = 4 * len(xt) / np.linalg.norm(xt, 2) ** 2
        for _ in range(STEPS):
            z = xt @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - tt) / len(xt)
            w -= rate * (xt.T @ g)
            b -= rate * g.sum(0)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        z = x[hold] @ w + b

        def loss(t: float) -> float:
            q = z / t - (z / t).max(1, keepdims=True)
            return -(q - np.log(np.exp(q).sum(1, keepdims=True)))[np.arange(len(q)), y[hold]].mean()

        temperature = min((0.25 * 1.15**i for i in range(20)), key=loss)
        w, b = np.round(w / temperature, 6), np.round(b / temperature, 6)
        self.bias = b.tolist()
        self.weights = {g: w[i].tolist() for g, i in at.items() if np.abs(w[i]).max() > 0}
        self.anchors = sorted({x for g in self.weights for x in g.split()} - FUNCTION_WORDS)
        self.templates = [(f, sorted(set(words(t)))) for f, texts in NOTICES.items() for t in texts]
        self.lengths = [(sorted(set(words(t))), len(words(t))) for texts in NOTICES.values() for t in texts]


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of fixed rows without Python on the executors: parsed from one JSON literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>")).alias("x")).select("x.*")


def normal(line):
    """Column: the words of a line; [''] if it has none."""
    return F.split(F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")), " ")


def rare_words() -> list[str]:
    """Words of which a text that holds CONFIRMED of some template's words has at least one."""
    out = set()
    for _, t in model().templates:
        out |= set(sorted(t, key=lambda x: (x in FUNCTION_WORDS, -len(x), x))[: len(t) - math.ceil(CONFIRMED * len(t) - 1e-9) + 1])
    return sorted(out)


def licence_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_, text_hash_, line_, family, chance, confirmed): the lines that the classifier takes for a licence notice."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key_"), F.xxhash64(F.col(text)).alias("text_hash_"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_", "l_"))
    return classified(rows.select("key_", "text_hash_", "line_", normal(F.col("l_")).alias("w_")))


def wrapped_notices(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_, text_hash_, break_, family): line breaks, by the number of the line before, that a confirmed notice runs over."""
    rows = docs.where(F.contains(F.col(text), F.lit("\n"))).select(F.col(key).alias("key_"), F.xxhash64(F.col(text)).alias("text_hash_"), F.transform(F.split(F.col(text), "\n", -1), normal).alias("l_"))
    ends = rows.select("key_", "text_hash_", F.transform("l_", lambda x: F.slice(x, F.greatest(F.size(x) - REACH + 1, F.lit(1)), REACH)).alias("tail_"), F.transform("l_", lambda x: F.slice(x, 1, REACH)).alias("head_"))
    near = F.transform("tail_", lambda x, i: F.struct(x.alias("a"), F.slice("head_", i + 2, REACH).alias("b")))
    each = ends.select("key_", "text_hash_", F.posexplode(near).alias("break_", "x_")).select("key_", "text_hash_", "break_", F.col("x_.a").alias("a_"), F.col("x_.b").alias("b_"))
    blank = F.array_position("b_", F.array(F.lit("")))
    run = F.slice(F.flatten(F.when(blank > 0, F.slice("b_", F.lit(1), (blank - 1).cast("int"))).otherwise(F.col("b_"))), 1, REACH)
    each = each.where(F.col("a_")[0] != "").select("key_", "text_hash_", "break_", F.size("a_").alias("n_"), F.concat("a_", run).alias("x_")).where(F.size("x_") > F.col("n_"))
    each = each.where(F.arrays_overlap("x_", F.array(*map(F.lit, rare_words()))))
    # stretches of a template's length and a half, the fullest one for each template
    templates = literal_table(docs.sparkSession, [[i, w, math.ceil(1.5 * n)] for i, (w, n) in enumerate(model().lengths)], "t_ int, words_ array<string>, long_ int")
    most = F.size("words_") * CONFIRMED
    some = each.join(F.broadcast(templates), F.size(F.array_intersect("x_", "words_")) >= most)
    starts = F.sequence(F.greatest(F.lit(1), F.col("n_") - F.col("long_") + 2), F.col("n_"))
    held = F.array_max(F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice("x_", i, F.col("long_")), "words_")).alias("held"), (-i).alias("at"))))
    some = some.withColumn("best_", held).where(F.col("best_.held") >= most)
    w = F.slice("x_", -F.col("best_.at"), F.col("long_"))
    found = classified(some.select("key_", "text_hash_", (F.col("break_").cast("long") * 1000 + F.col("t_")).alias("line_"), w.alias("w_")))
    return found.where("confirmed").select("key_", "text_hash_", F.floor(F.col("line_") / 1000).cast("int").alias("break_"), "family").distinct()


def classified(split: DataFrame) -> DataFrame:
    """Those rows (key_, text_hash_, line_, w_) whose words the classifier takes for a notice: family, chance, confirmed."""
    m, spark = model(), split.sparkSession
    near = split.where(F.arrays_overlap("w_", F.array(*map(F.lit, m.anchors)))).distinct()
    n = F.size("w_")

    def gram(k: int):
        i = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(i, lambda s: F.array_join(F.slice("w_", s, k), " "))

    each = near.select("key_", "text_hash_", "line_", "w_", F.explode(F.array_distinct(F.concat("w_", gram(2), gram(3)))).alias("gram_"))
    table = literal_table(spark, [[g, w] for g, w in m.weights.items()], "gram_ string, v_ array<double>")
    sums = [F.sum(F.col("v_")[c]).alias(f"s{c}") for c in range(len(m.classes))]
    scored = each.join(F.broadcast(table), "gram_").groupBy("key_", "text_hash_", "line_").agg(F.first("w_").alias("w_"), *sums)
    z = F.array(*(F.col(f"s{c}") + F.lit(b) for c, b in enumerate(m.bias)))
    scored = scored.select("key_", "text_hash_", "line_", "w_", z.alias("z_")).withColumn("top_", F.array_max("z_"))
    total = F.aggregate("z_", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top_")))
    names = F.array(*map(F.lit, m.classes))
    best = scored.select("key_", "text_hash_", "line_", "w_", F.element_at(names, F.array_position("z_", F.col("top_")).cast("int")).alias("family"), (F.lit(1.0) / total).alias("chance"))
    best = best.where((F.col("family") != "unknown") & (F.col("chance") > CERTAIN))
    templates = literal_table(spark, [[f, w] for f, w in m.templates], "family string, t_ array<string>")
    held = F.size(F.array_intersect("w_", "t_")) / F.size("t_")
    return best.join(F.broadcast(templates), "family").groupBy("key_", "text_hash_", "line_", "family", "chance").agg((F.max(held) >= CONFIRMED).alias("confirmed"))


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_notices, families, n_unconfirmed) for every row of ``docs``; other columns play no part.

    n_notices counts lines with a confirmed family and, besides these, confirmed notices over line breaks (of one family at
    successive breaks one), families lists these sorted and joined by commas ('' for none),
    n_unconfirmed counts lines whose predicted family no template bears out and that
    no such notice of the family runs through. Null and empty texts have none. Repeated
    rows are returned each with the same values, null keys too; an empty table gives an empty one.
    """
    lines = licence_lines(docs, key, text).select("key_", "text_hash_", "family", F.when(F.col("confirmed"), F.col("line_")).alias("sure_"), F.when(~F.col("confirmed"), F.col("line_")).alias("unsure_"), F.lit(None).cast("int").alias("break_"))
    none = F.lit(None).cast("int")
    each = lines.unionByName(wrapped_notices(docs, key, text).select("key_", "text_hash_", "family", none.alias("sure_"), none.alias("unsure_"), "break_"))
    each = each.groupBy("key_", "text_hash_", "family").agg(*(F.collect_set(c).alias(c) for c in ("sure_", "unsure_", "break_")))
    own = F.filter("break_", lambda i: ~F.array_contains("sure_", i) & ~F.array_contains("sure_", i + 1))
    each = each.withColumn("own_", own).select(
        "key_", "text_hash_", "family",
        (F.size("sure_") + F.size(F.filter("own_", lambda i: ~F.array_contains("own_", i - 1)))).alias("sure_"),
        F.size(F.filter("unsure_", lambda i: ~F.array_contains("break_", i) & ~F.array_contains("break_", i - 1))).alias("unsure_"),
    )
    found = each.groupBy("key_", "text_hash_").agg(
        F.sum(F.col("sure_").cast("long")).alias("n_"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("sure_") > 0, F.col("family")))), ",").alias("f_"),
        F.sum(F.col("unsure_").cast("long")).alias("u_"),
    )
    rows = docs.select(F.col(key).alias("k_"), F.xxhash64(F.col(text)).alias("t_"))
    out = rows.join(found, F.col("k_").eqNullSafe(F.col("key_")) & (F.col("t_") == F.col("text_hash_")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(F.col("k_").alias(key), zero("n_").alias("n_notices"), F.coalesce("f_", F.lit("")).alias("families"), zero("u_").alias("n_unconfirmed"))
