"""Licence scans: a paragraph classifier of sparse word n-grams, with DataFrame functions only.

A paragraph is a run of lines that hold a letter or digit (so wrapped lines are joined, and lines of signs
only part paragraphs); each line of a longer paragraph is scored by itself as well. Distinct word 1- to
3-grams, of ``[a-z0-9]+`` after A-Z in lower case, meet the weights of a multinomial logistic regression
that is trained (numpy, on the driver, in seconds) on names of licence families in the ways they are
cited, on sentences of the licences, mutilated in seeded ways, and on lines that only sound like them.
L1 leaves few n-grams with weights. A temperature, fitted on wordings that training never sees,
calibrates the probabilities, those of the class ``unknown`` as well. A prediction is confirmed if the
paragraph holds ``CONFIRM`` of the 3-grams of one of the family's templates. A paragraph of several lines
counts only if it is confirmed and nearer to a template than each of its lines is; else its lines count.

Most texts needn't be scored: a family wins over ``unknown`` only by n-grams that weigh more for it. Each of
these is filed under one of its words, and the sum of all that is filed under the words of a text bounds what
it can reach. Texts and paragraphs whose bound is under the bias of ``unknown`` are unknown for certain; this
follows from the trained weights and changes no result.

Null and empty texts have no rows; repeated rows give repeated rows; of families that tie the first in the
order of ``TEMPLATES`` wins; other columns are not looked at. Whole texts are read, however long.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Least probability of a family, and least share of a template's 3-grams that confirms it.
LEAST, CONFIRM = 0.5, 0.5

#: What a family is called.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL v3", "GNU GPL", "GPL version 2", "GPL version 3", "GPL v2", "GPL v3", "GPL-3.0-or-later", "GPL-2.0-only", "GPL"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL", "LGPL v3", "LGPL version 2.1", "LGPL-2.1-only", "LGPL"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL v3", "GNU AGPL", "AGPL v3", "AGPL-3.0", "AGPL"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD 3-Clause", "BSD-2-Clause", "BSD-3-Clause", "3-clause BSD license", "2-clause BSD license", "BSD license"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC licence", "ISC"],
    "CC-BY": ["CC BY 4.0", "CC BY", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "CC BY-ND", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives License"],
    "CC0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero license"],
    "Unlicense": ["Unlicense"],
}
#: How they are cited; the last ones are kept from training and fit the temperature.
CITED = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {} terms.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "License: {}", "Available under {}.", "{}"]
CITED_HELD = ["This program is distributed under the terms of the {}.", "All code here is covered by the {}.", "You may use it under {}.", "Published by its authors under the {}."]
#: Names of one word aren't cited without any other word.
BARE = "{}"

#: Sentences of the licences themselves.
SENTENCES: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0": ["This work is dedicated to the public domain under the Creative Commons Zero license.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
}

#: Lines of no family.
OTHERS = [
    "All rights reserved.", "Copyright 2020 by the authors.", "Copyright (c) 2019 Example Inc. All rights reserved.", "A driving licence is required for this job.", "Her licence was renewed last year.",
    "The fishing license costs ten dollars.", "Permission denied.", "You need permission to enter the building.", "The council gave its permission for the works.", "See the license file for details.",
    "The work is licensed to the university.", "Licensed under the terms agreed with the vendor.", "This product is licensed, not sold.", "The warranty covers parts and labour for two years.", "The version of the public library was released under a new name.",
    "License plate numbers were recorded.", "A general license for export was issued.", "The software license agreement applies to this version.", "Released under the old bridge.", "He was licensed under state law as a nurse.",
    "No part of this publication may be reproduced without prior written permission.", "Copyright law protects the author of a work.", "The book entered the public domain in 1998.", "Permission is hereby refused.", "Redistribution of income was debated.",
    "The bsd of the city is near the mit campus.", "Apache helicopters flew over the base.", "The licence fee rose in 2.0 percent steps, version 3 of the plan says.", "The license was granted free of charge.", "This license is required by applicable law.",
    "Creative commons are shared spaces.", "Free software foundation members met.", "Licensed under", "This work is licensed under a special agreement.", "Released under license.", "Distributed under license from the owner.",
    "The terms of the general public are plain.", "A public license for fishing is published each year.", "He has read the terms of the contract.", "This program is shown on Mondays.", "Version 3 of the report is available.",
    "The source code of the program was lost.", "The conditions of the roads are met with complaints.", "The library is open to the general public.", "A free copy of the book is available on the table.", "Attribution of the painting is disputed.",
    "Commercial use of the river was stopped.", "The Mozilla campus is in California.", "The clause was struck from the bill.", "Three clauses follow.", "The foundation is free to publish.", "Charge the battery free of charge.", "See section 2.0 and 4.0 of the plan.",
]
#: What else things are released or covered under, and lines of no family that are kept from training.
NO_NAMES = ["old bridge", "authority of the court", "terms of the contract", "new name", "influence of the moon", "title Nightfall", "agreement", "ministry of works", "federal rules"]
OTHERS_HELD = ["The use of the software is governed by a contract.", "Copyright remains with the publisher.", "A licence is needed to sell alcohol.", "The public domain is shrinking.", "Without permission nobody may enter.", "The Apache people live in the south.", "Terms apply to all later versions.", "Redistribution of land was promised.", "Creative work is common in this town."]

#: Sentences in which a name is nothing but a name.
NOUNS = ["She went to {} to study.", "The {} chapter of 1999 follows.", "People of {} met again.", "Many came from {} with their music.", "{} won the game.", "A talk about {}."]

#: Words too common, in some language, to make features by themselves; digits are such words as well.
COMMON = set("mit nd nc sa der die das und von zu den la le les de des du un une est en et il el los las del por con que se su a all an and any are as at be by can for from has have he her his in is it its may no not of on or our see she that the their they this to under was we were which who will with without you your".split())


def _common(word: str) -> bool:
    return word in COMMON or word.isdigit()


def grams(line: str) -> list[str]:
    t = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
    return list(dict.fromkeys(" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)))


def _mutilated(line: str, rng: np.random.Generator) -> str:
    """The line in prose, with some words lost, or cut short; a third stays as it is."""
    words, kind = line.split(), rng.integers(3)
    if kind == 1 and len(words) > 5:
        words = [w for w in words if rng.random() > 0.1]
    if kind == 2:
        filler = ["this", "file", "the", "and", "its", "code", "text", "see", "data", "of", "all"]
        words = list(rng.choice(filler, rng.integers(0, 4))) + words + list(rng.choice(filler, rng.integers(0, 4)))
    return " ".join(words)


def _cited(patterns: list[str], name: str) -> list[str]:
    return [p.format(name) for p in patterns if p != BARE or len(re.findall("[A-Za-z0-9]+", name)) > 1]


#: By family: all that a paragraph is compared with.
TEMPLATES: dict[str, list[str]] = {c: [x for n in names for x in _cited(CITED + CITED_HELD, n)] + SENTENCES.get(c, []) for c, names in NAMES.items()}


def _training() -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Lines and classes to learn from, and those of wordings that are kept from it."""
    rng = np.random.default_rng(7)
    train, held = [], []
    for k, (c, names) in enumerate(NAMES.items()):
        train += [(x, k) for n in names for x in _cited(CITED, n)]
        train += [(x, k) for x in SENTENCES.get(c, [])] * 2
        held += [(x, k) for n in names for x in _cited(CITED_HELD, n)]
    unknown = len(NAMES)
    train += [(p.format(n), unknown) for p in NOUNS for n in ("MIT", "Apache", "BSD", "ISC", "GPL", "Mozilla", "Creative Commons")]
    train += [(x, unknown) for x in OTHERS] * 3 + [(p.format(n), unknown) for p in CITED[:-1] for n in NO_NAMES[::2]]
    held += [(x, unknown) for x in OTHERS_HELD * 3] + [(p.format(n), unknown) for p in CITED_HELD for n in NO_NAMES[1::2]]
    return train + [(_mutilated(x, rng), k) for x, k in train for _ in range(2)], held + [(_mutilated(x, rng), k) for x, k in held]


def _matrix(rows: list[tuple[str, int]], at: dict[str, int], classes: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(rows), len(at)), np.float32), np.zeros((len(rows), classes), np.float32)
    for r, (text, k) in enumerate(rows):
        x[r, [at[g] for g in grams(text) if g in at]] = 1
        y[r, k] = 1
    return x, y


@lru_cache(maxsize=1)
def model() -> dict:
    """classes, bias and weights by n-gram (scaled by the temperature, six decimals), templates' n-grams, and anchors."""
    classes = [*NAMES, UNKNOWN]
    rows, kept = _training()
    seen: dict[str, int] = {}
    for x, _ in rows:
        for g in grams(x):
            seen[g] = seen.get(g, 0) + 1
    names = sorted(g for g, n in seen.items() if n >= 3 and not all(map(_common, g.split())))
    at = {g: k for k, g in enumerate(names)}
    x, y = _matrix(rows, at, len(classes))
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[-1] = 2.0  # a line of which nothing is known
    norm, u = 0.0, np.ones(len(names), np.float32)
    for _ in range(30):  # the largest singular value, squared
        u = x.T @ (x @ u)
        norm = float(np.linalg.norm(u))
        u /= norm
    rate, l1, v = 2 * len(x) / norm, 2e-4, w.copy()
    for step in range(150):  # accelerated proximal gradient
        z = x @ v + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
        new = v - rate * (x.T @ p)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        v = new + step / (step + 3) * (new - w)
        w = new
    xh, yh = _matrix(kept, at, len(classes))
    w, b = w.astype(np.float64), b.astype(np.float64)

    def loss(scale: float) -> float:
        z = scale * (xh @ w + b)
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (z * yh).sum(axis=1)).mean())

    scale = min(np.linspace(0.3, 4, 38), key=loss)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    weights = {names[k]: [round(float(s), 6) for s in scale * w[k]] for k in used}
    size = lambda t: min(3, len(re.findall("[A-Za-z0-9]+", t)))
    templates = {c: [list(t) for t in dict.fromkeys(tuple(g for g in grams(x) if g.count(" ") == size(x) - 1) for x in TEMPLATES[c])] for c in TEMPLATES}
    return {"classes": classes, "bias": [round(float(s), 6) for s in scale * b], "weights": weights, "templates": templates, "anchors": _anchors(weights)}


def _anchors(weights: dict[str, list[float]]) -> dict[str, list[float]]:
    """By word: what the n-grams filed under it add for each family over unknown at most. Words that many have first."""
    open_ = {g: [x for x in g.split() if not _common(x)] for g, w in weights.items() if max(w[:-1]) > w[-1]}
    found: dict[str, list[float]] = {}
    while open_:
        times: dict[str, int] = {}
        for words in open_.values():
            for x in set(words):
                times[x] = times.get(x, 0) + 1
        best = min(times, key=lambda x: (-times[x], x))
        filed = [g for g, words in open_.items() if best in words]
        found[best] = [sum(max(0.0, weights[g][k] - weights[g][-1]) for g in filed) for k in range(len(weights[filed[0]]) - 1)]
        open_ = {g: words for g, words in open_.items() if g not in set(filed)}
    return found


def _reaches(words: Column) -> Column:
    """Whether any family can win over unknown in a text of these words."""
    m = model()
    names, bounds = F.array(*map(F.lit, m["anchors"])), F.from_json(F.lit(json.dumps(m["anchors"])), "map<string,array<double>>")
    least = m["bias"][-1] - max(m["bias"][:-1]) - 1e-6
    total = F.aggregate(F.array_intersect(words, names), F.array(*[F.lit(0.0)] * (len(m["classes"]) - 1)), lambda acc, x: F.zip_with(acc, F.element_at(bounds, x), lambda a, b: a + b))
    return F.array_max(total) >= F.lit(least)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row: generators aren't merged into what uses them."""
    return df.withColumn(name, F.explode(F.array(value)))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> Column:
    return F.expr(f"regexp_extract_all({_LOWER.format(text)}, '[a-z0-9]+', 0)")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _row, _block, line_no, n_lines, _words): paragraphs, and the lines of those of several lines."""
    found = docs.select(key, text).where(_reaches(words(text))).withColumn("_row", F.monotonically_increasing_id())
    found = _once(found, "_lines", F.split(text, "\n", -1))
    found = _once(found, "_full", F.expr("transform(_lines, l -> l rlike '[A-Za-z0-9]')"))
    spots = lambda at, other: F.expr(f"filter(sequence(0, size(_full) - 1), i -> _full[i] and (i = {at} or not _full[i + {other}]))")
    found = _once(_once(found, "_starts", spots("0", "-1")), "_ends", spots("size(_full) - 1", "1"))
    blocks = F.expr("zip_with(_starts, _ends, (s, e) -> struct(s as line_no, e - s + 1 as n_lines, array_join(slice(_lines, s + 1, e - s + 1), '\n') as t))")
    found = found.select(key, "_row", "_lines", F.posexplode(blocks).alias("_block", "b"))
    each = F.expr("concat(array(b), if(b.n_lines = 1, array(), transform(sequence(b.line_no, b.line_no + b.n_lines - 1), i -> struct(i as line_no, 1 as n_lines, _lines[i] as t))))")
    found = found.select(key, "_row", "_block", F.explode(each).alias("u")).select(key, "_row", "_block", "u.line_no", "u.n_lines", F.col("u.t").alias("_t"))
    return _once(found, "_words", words("_t")).where(_reaches(F.col("_words")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, n_lines, paragraph, family, probability, similarity, confirmed): one row for each paragraph, or line of one, of a family."""
    m = model()
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    joined = lambda n: F.expr(f"if(size(_words) < {n}, array(), transform(sequence(1, size(_words) - {n - 1}), i -> array_join(slice(_words, i, {n}), ' ')))")
    vocabulary, weights = F.array(*map(F.lit, m["weights"])), F.from_json(F.lit(json.dumps(m["weights"])), "map<string,array<double>>")
    templates = F.from_json(F.lit(json.dumps(m["templates"])), "map<string,array<array<string>>>")
    made = _once(paragraphs(own, "_key", "_text"), "_grams", F.concat("_words", joined(2), joined(3)))
    bias = F.array(*map(F.lit, m["bias"]))
    made = _once(made, "_z", F.aggregate(F.array_intersect("_grams", vocabulary), bias, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b)))
    made = _once(made, "_top", F.array_max("_z"))
    family = F.element_at(F.array(*map(F.lit, m["classes"])), F.array_position("_z", F.col("_top")).cast("int"))
    share = 1.0 / F.aggregate(F.col("_z"), F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("_top")))
    made = _once(_once(made, "family", family), "probability", share).where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST))
    alike = F.array_max(F.transform(F.element_at(templates, F.col("family")), lambda t: F.size(F.array_intersect(t, F.col("_grams"))) / F.size(t)))
    made = _once(made, "similarity", alike)
    # What is left, and moves here, is a few words of each licence.
    near = Window.partitionBy("_row", "_block", "family")
    made = made.withColumn("_line", F.max(F.when(F.col("n_lines") == 1, F.col("similarity"))).over(near)).withColumn("_whole", F.max(F.when((F.col("n_lines") > 1) & (F.col("similarity") >= CONFIRM), F.col("similarity"))).over(near))
    whole = F.col("_whole").isNotNull() & (F.col("_line").isNull() | (F.col("_whole") > F.col("_line")))
    made = made.where(F.when(F.col("n_lines") == 1, ~whole).otherwise(whole))
    return made.select(F.col("_key").alias(key), "line_no", "n_lines", F.col("_t").alias("paragraph"), "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"))


def sql() -> str:
    """The registered query over ``documents``, for DuckDB, with the trained weights as values; it scores every paragraph and line."""
    m = model()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({quote(g)}, {k}, {v!r}::double)" for g, w in m["weights"].items() for k, v in enumerate(w) if v)
    bias = ", ".join(f"({k}, {quote(c)}, {b!r}::double)" for k, (c, b) in enumerate(zip(m["classes"], m["bias"])))
    temps = ", ".join(f"({quote(c)}, {n}, {quote(g)}, {len(t)})" for c, ts in m["templates"].items() for n, t in enumerate(ts) for g in t)
    return f"""
        with s as (select doc_id, unnest(l) as line, unnest(range(len(l))) as line_no from (select doc_id, string_split(text, chr(10)) as l from documents)),
        f as (select *, regexp_matches(line, '[A-Za-z0-9]') as full_ from s),
        n as (select *, sum(case when full_ then 0 else 1 end) over (partition by doc_id order by line_no) as block from f),
        b as (select doc_id, block, min(line_no) as line_no, count(*) as n_lines, string_agg(line, chr(10) order by line_no) as t from n where full_ group by all),
        u as (select doc_id, block, line_no, n_lines, t from b union all select n.doc_id, n.block, n.line_no, 1, n.line from n join b on b.doc_id = n.doc_id and b.block = n.block and b.n_lines > 1 where n.full_),
        w as (select doc_id, block, line_no, n_lines, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as t from u),
        g as (select distinct doc_id, line_no, n_lines, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))], [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)])) as gram from w),
        weights(gram, k, v) as (values {weights}), classes(k, family, bias) as (values {bias}), templates(family, n, gram, size) as (values {temps}),
        y as (select doc_id, line_no, n_lines, k, sum(v) as v from g join weights using (gram) group by all),
        z as (select w.doc_id, w.block, w.line_no, w.n_lines, c.k, c.family, c.bias + coalesce(y.v, 0) as z from w cross join classes as c left join y on y.doc_id = w.doc_id and y.line_no = w.line_no and y.n_lines = w.n_lines and y.k = c.k),
        p as (select *, exp(z - max(z) over l) as e, row_number() over (partition by doc_id, line_no, n_lines order by z desc, k) as r from z window l as (partition by doc_id, line_no, n_lines)),
        q as (select *, e / sum(e) over (partition by doc_id, line_no, n_lines) as probability from p),
        o as (select * from q where r = 1 and family <> '{UNKNOWN}' and probability >= {LEAST}),
        a as (select doc_id, line_no, n_lines, family, max(hits / size::double) as similarity from (select doc_id, line_no, n_lines, family, n, size, count(*) as hits from g join templates using (gram) group by all) group by all),
        c as (select o.*, coalesce(similarity, 0) as similarity from o left join a using (doc_id, line_no, n_lines, family)),
        d as (select *, max(similarity) filter (n_lines = 1) over x as best, max(similarity) filter (n_lines > 1 and similarity >= {CONFIRM}) over x as whole from c window x as (partition by doc_id, block, family))
        select doc_id, line_no, n_lines, family, round(probability, 5) as probability, round(similarity, 6) as similarity, similarity >= {CONFIRM} as confirmed
        from d where case when n_lines = 1 then whole is null or whole <= best else whole is not null and (best is null or whole > best) end"""
