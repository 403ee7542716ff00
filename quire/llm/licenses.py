"""License scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a run of lines that are not blank. Notices are looked for in its
lines and in its windows, two or more lines side by side, so that neither a
notice that is wrapped over lines nor one beside other text is lost; a window
has room for WINDOW words before and after a line end. Of those that overlap,
the one most like a template counts, and the shortest of equal ones.

A line or window becomes its set of word one- and two-grams. A sparse multinomial
logistic regression over the n-grams of the templates gives each licence family,
one class for notices of other licences (unknown) and one for everything else
(other) a probability. It is fitted here, on fixed texts alone: the templates and
UNKNOWN_NOTICES with words dropped and foreign words put around them, and
ORDINARY text with loose words of templates in it. N-grams of words of ORDINARY text alone carry
no weight. No row of the corpus is used, so the scanner is the same for all of
them. HELD_OUT notices, wordings that are in no template, calibrate it: the
threshold is the lowest probability from which families are right in PRECISION
of them, with notices of other licences among them; 1.0, which names no family,
if none is. A line or window whose best class is unknown, or whose best family
stays under the threshold, is of unknown licence. A family is confirmed if the
line or window holds enough of the n-grams of one of its templates.

Scoring is DataFrame expressions alone: no Python runs on the executors. The
fitted weights are literals, their number bounded by the templates.

Rows: one output row per input row. A null or empty text has no paragraphs.
Repeated rows get equal results; extra columns, whatever their names, are
ignored; an empty table gives an empty result. Of overlapping windows that tie,
the first counts. Texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, whole_text, written

#: Customary wordings of licence notices, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "public-domain": ("This work is dedicated to the public domain under CC0 1.0 Universal.",),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited."),
}
#: Other wordings of the families' notices, which no fit sees.
HELD_OUT = {
    "apache": ("This file is made available under the Apache License, Version 2.0; see the file LICENSE.", "Distributed under the terms of the Apache License 2.0."),
    "gpl": ("This library is released under the GNU General Public License, version 2 or any later version.", "You may redistribute and modify this under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "mit": ("The code is distributed under the MIT License.", "This project is licensed under the terms of the MIT License."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source or binary forms are permitted provided that the following conditions are met."),
    "mpl": ("This file is subject to the Mozilla Public License, version 2.0.",),
    "cc-by-nc": ("The text is available under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC 4.0."),
    "cc-by": ("The text is available under CC BY 4.0.", "This article is distributed under the Creative Commons Attribution 4.0 International License."),
    "public-domain": ("The author has dedicated this work to the public domain under CC0 1.0.",),
    "proprietary": ("Copyright by the author, all rights reserved.",),
}
#: Notices of licences that have no family; the fit sees every other one.
UNKNOWN_NOTICES = (
    "Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL, version 1.2 only.",
    "This software is provided as is, without any express or implied warranty.", "The software comes as is, without express or implied warranty of any kind.",
    "Distributed under the Boost Software License, Version 1.0.", "This library is under the Boost Software License.",
    "Licensed under the Eclipse Public License, version 2.0.", "Made available under the terms of the Eclipse Public License.",
    "Licensed under the Artistic License 2.0.", "You may use this under the terms of the Artistic License.",
    "Released under the zlib License.", "This code is licensed under the zlib License.",
    "Data are licensed under the Open Database License.", "Available under the Open Database License, version 1.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.", "The text is under a Creative Commons Attribution-NoDerivatives 4.0 License.",
    "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: ISC",
    "Everyone is permitted to copy and distribute verbatim copies of this license document.", "Permission to use, copy and distribute verbatim copies of this document is granted.",
)
#: Notices of licences of which the fit sees none.
UNSEEN_NOTICES = (
    "Licensed under the ISC License.", "Released under the SIL Open Font License, Version 1.1.", "Licensed under the Microsoft Public License.", "This file is licensed under the Elastic License 2.0.",
    "Licensed under the Universal Permissive License v 1.0.", "Distributed under the terms of the Server Side Public License, version 1.", "Released under the Unlicense.", "This package is under the Academic Free License, version 3.0.",
    "You may use this file under the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: AFL-3.0",
)
#: Sentences that are no notices, some of them about licences.
ORDINARY = (
    "The author of this work lives in the city and has written for many years.", "You can use the tool in the kitchen, but it may not be safe for any person who is new to it.",
    "A licence to drive is granted to those who pass the test.", "The following is a list of the files in the source of the program.", "We may copy or use what is in the public library.",
    "This is the version that was published in the first year of the war.", "Under the terms of the treaty the land was returned to its owners.", "The software runs on any machine with enough memory.",
    "She asked for permission to leave, and it was granted by the court.", "The rights of the people are in the law of the country.", "The form of the river is subject to change, and so are the conditions on it.",
    "It is strictly a matter of taste, as he said.", "By the end of the day the work had been done with the means that were at hand.", "With or without him, they would go on.",
    "No one knows if the document is the original or a copy of it.", "Free of charge means that you do not pay for it.", "The general of the army was dedicated to his men.", "International trade in common goods has grown.",
    "Er ging mit dem Hund in die Stadt und kam mit der Bahn zur Arbeit, wie es in der Union Brauch ist.", "Sie sprach mit ihm und mit allen anderen, die da waren.", "Les data de la base sont dans le service, avec les formes du mot et de la version.",
    "La version de los datos es de la base y se usa en el servicio con todas las formas.", "Everyone met at the open door of the union and went to the database of the European museum.", "The express train provided seats, and copies of the data were released to the press.",
    "To obtain the data, go to the documentation and open the forms to the left.", "They distribute food to the poor and modify the menu to the season.", "It is implied that the warranty is met by the artistic director.", "He was permitted to copy it, and to the end he kept copying.",
    "An eclipse of the sun was seen on the 3 of May, and it gave a boost to tourism.", "The binary star moves to the north without restriction, and with all its modification.", "The attribution of the painting is open, and so is the compliance of the seller.",
    "All of them were in the domain of the king.", "The code of the law must be read as it is published.", "To deal with the matter we have to look at all that is associated with it.", "The source of the river is in the mountains, and its form is that of a lake.",
    "Creative people have all sorts of ideas, and universal ones at that.", "He obtained a file and a saw, and modified the lock.", "The foundation of the house is made of stone.", "Any work of this kind is prohibited on that day except in the morning.",
)
OTHER = "other"
UNKNOWN = "unknown"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
COPIES = 60
PRECISION = 0.99
#: Share of a template's n-grams that confirms its family.
CONFIRMED = 0.6
#: Words that a wrapped notice can have on either side of a line end: twice those of the longest template.
WINDOW = 2 * max(len(re.findall(TOKEN, t.lower())) for own in TEMPLATES.values() for t in own)
#: One blank line or more between two lines.
BLANK = r"\n(?:[^\S\n]*+\n)++"


def grams(text: str) -> set[str]:
    words = re.findall(TOKEN, text.lower())
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def grams_of(words: Column) -> Column:
    """Distinct word one- and two-grams of an array of words."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_union(words, pairs)


@dataclass
class Scanner:
    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # (n-grams, classes): the families, UNKNOWN, OTHER
    bias: np.ndarray
    threshold: float

    def probabilities(self, found: set[str]) -> np.ndarray:
        rows = [self.weights[i] for i, g in enumerate(self.vocabulary) if g in found]
        z = self.bias + np.sum(rows, axis=0) if rows else self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def words(self) -> list[str]:
        """Words of which every n-gram with a weight has one."""
        common = {w for x in ORDINARY for w in re.findall(TOKEN, x.lower())}
        return sorted({w for g in self.vocabulary for w in g.split() if w not in common})


def _fitted(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 400, rate: float = 2.0, sparse: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by proximal gradient steps with an L1 penalty."""
    w, b, one = np.zeros((x.shape[1], classes)), np.zeros(classes), np.eye(classes)[y]
    weight = 1 / np.bincount(y, minlength=classes)[y] / classes
    for _ in range(rounds):
        z = x @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        gap = (one - e / e.sum(1, keepdims=True)) * weight[:, None]
        w += rate * (x.T @ gap)
        b += rate * gap.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
    return w, b


def fit() -> Scanner:
    """Fit on the fixed texts above; the same in every run."""
    classes = [*TEMPLATES, UNKNOWN, OTHER]
    notices = [(n, t) for n, f in enumerate(TEMPLATES) for t in TEMPLATES[f]] + [(len(TEMPLATES), t) for t in UNKNOWN_NOTICES[::2]]
    # An n-gram tells something only if one of its words does.
    common = {w for x in ORDINARY for w in re.findall(TOKEN, x.lower())}
    vocabulary = sorted(g for g in {g for _, t in notices for g in grams(t)} if not common.issuperset(g.split()))
    column = {g: i for i, g in enumerate(vocabulary)}
    rng = np.random.default_rng(17)
    words = [w for x in ORDINARY for w in x.split()]
    texts, labels = [], []
    for n, t in notices:
        for k in range(COPIES):
            own = [w for w in t.split() if k == 0 or rng.random() > 0.12]
            around = rng.choice(words, 12).tolist() if k % 2 else []
            texts.append(" ".join([*around[:6], *own, *around[6:]]))
            labels.append(n)
    # Everything else: ordinary sentences, and loose words of notices among them.
    loose = [w for _, t in notices for w in t.split()]
    for k in range(8 * COPIES):
        extra = rng.choice(loose, int(rng.integers(0, 3))).tolist()
        texts.append(" ".join([ORDINARY[k % len(ORDINARY)], *extra]))
        labels.append(len(classes) - 1)
    w, b = _fitted(_matrix(texts, column), np.array(labels), len(classes))
    if (p_none := np.exp(b) / np.exp(b).sum())[-1] <= 0.5:
        raise RuntimeError(f"the fit takes {p_none[-1]:.2f} of paragraphs without evidence for other")
    held = [(n, t) for n, f in enumerate(TEMPLATES) for t in HELD_OUT[f]] + [(len(TEMPLATES), t) for t in (*UNKNOWN_NOTICES[1::2], *UNSEEN_NOTICES)]
    z = _matrix([t for _, t in held], column) @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    guess, truth = p[:, :-1].argmax(1), np.array([n for n, _ in held])
    best = np.where(guess < len(TEMPLATES), p.max(1), 0.0)
    threshold = next((float(t) for t in np.arange(0.5, 1.0, 0.01) if (over := best >= t).any() and (guess[over] == truth[over]).mean() >= PRECISION), 1.0)
    used = np.flatnonzero(np.abs(w).sum(1) > 0)
    return Scanner(classes, [vocabulary[i] for i in used], w[used], b, threshold)


def _matrix(texts: list[str], column: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(column)))
    for r, t in enumerate(texts):
        x[r, [column[g] for g in grams(t) if g in column]] = 1
    return x


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def _windows(lines: str, sizes: str, flags: str, telling: Column, known: Column) -> Column:
    """Array of (first, last, grams) of the lines and windows with a telling n-gram; grams are the known ones.

    lines, sizes and flags (whether a line has a telling word) are columns of a
    table: what a lambda names is computed again for every element.
    """
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))

    def of(own: Column, i: Column) -> Column:
        # The lines after this one that start within WINDOW words of its end; each line has a word.
        after = F.slice(sizes, i + 2, F.lit(WINDOW))
        reach = F.aggregate(after, start, lambda a, x: F.when(a["words"] < WINDOW, F.struct((a["words"] + x).alias("words"), (a["lines"] + 1).alias("lines"))).otherwise(a), lambda a: a["lines"])
        tail = F.slice(own, F.greatest(F.size(own) - WINDOW, F.lit(0)) + 1, F.lit(WINDOW))
        ends = F.filter(F.sequence(F.lit(0), reach), lambda k: F.exists(F.slice(flags, i + 1, k + 1), lambda x: x))
        later = lambda k: F.flatten(F.transform(F.slice(lines, i + 2, k), lambda x: F.slice(x, 1, WINDOW)))
        texts = F.transform(ends, lambda k: F.struct(k.alias("k"), grams_of(F.when(k == 0, own).otherwise(F.concat(tail, later(k)))).alias("grams")))
        found = F.filter(texts, lambda x: F.arrays_overlap(x["grams"], telling))
        return F.transform(found, lambda x: F.struct(i.alias("first"), (i + x["k"]).alias("last"), F.array_intersect(x["grams"], known).alias("grams")))

    return F.flatten(F.transform(lines, of))


def _apart(units: Column) -> Column:
    """The units (first, last, ...) that overlap none before them."""
    none = F.slice(units, 1, 0)
    return F.aggregate(units, none, lambda got, x: F.when(F.exists(got, lambda y: (y["first"] <= x["last"]) & (y["last"] >= x["first"])), got).otherwise(F.concat(got, F.array(x))))


def paragraphs(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, mark, paragraph, first, last, family, probability, similarity, confirmed) of the notices, the lines first to last of a paragraph.

    family is unknown where the best one stays under the calibrated probability
    though a licence is more likely than none. Lines without a word do not count.
    """
    texts = docs.select("doc_id", whole_text().alias("text")).select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", BLANK).alias("runs"))
    runs = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "mark", F.posexplode("runs").alias("paragraph", "run"))
    vocabulary = F.array(*[F.lit(g) for g in scanner.vocabulary])
    known = F.array(*[F.lit(g) for g in sorted({*scanner.vocabulary, *(g for own in TEMPLATES.values() for t in own for g in grams(t))})])
    # A paragraph without any n-gram that has a weight is of no licence: the bias says so. Such an n-gram has a telling word.
    words = scanner.words()
    runs = runs.where(F.lower("run").rlike(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])"))
    lines = F.filter(F.transform(F.split("run", "\n"), _words), lambda x: F.size(x) > 0)
    runs = runs.select("row", "doc_id", "mark", "paragraph", lines.alias("lines"))
    flags = F.transform("lines", lambda x: F.arrays_overlap(x, F.array(*[F.lit(w) for w in words])))
    runs = written(runs.select("*", F.transform("lines", F.size).alias("sizes"), flags.alias("flags")), "paragraphs")
    hit = runs.select("row", "doc_id", "mark", "paragraph", F.inline(_windows("lines", "sizes", "flags", vocabulary, known)))
    hit = written(hit.withColumn("n", F.size("grams")), "windows")
    key = ["row", "doc_id", "mark", "paragraph", "first", "last", "n"]
    named = scanner.families[: len(TEMPLATES)]
    templates = [(f, grams(t)) for f in named for t in TEMPLATES[f]]
    weights = dict(zip(scanner.vocabulary, scanner.weights.tolist(), strict=True))
    classes = len(scanner.families)
    # A row for each n-gram and class that it has a weight for, and for each template that it is in.
    rows = [(g, n, w) for g, own in weights.items() for n, w in enumerate(own) if w]
    rows += [(g, classes + n, 1.0 / len(own)) for n, (_, own) in enumerate(templates) for g in sorted(own)]
    table = docs.sparkSession.createDataFrame(rows, "gram string, slot int, worth double")
    met = hit.select(*key, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    met = met.groupBy(*key, "slot").agg(F.sum("worth").alias("worth"))
    # At most one entry for each class and template.
    met = met.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "worth"))).alias("m"))
    bias = F.array(*[F.lit(float(b)) for b in scanner.bias])
    met = met.withColumn("z", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda n: F.get(bias, n) + F.coalesce(F.try_element_at("m", n), F.lit(0.0))))
    met = met.withColumn("top", F.array_max("z")).withColumn("e", F.transform("z", lambda v: F.exp(v - F.col("top"))))
    met = met.withColumn("whole", F.aggregate("e", F.lit(0.0), lambda x, y: x + y)).where(F.get("e", F.lit(classes - 1)) / F.col("whole") < 0.5)
    licences = F.slice("e", F.lit(1), F.lit(classes - 1))
    met = met.withColumn("likeliest", F.array_position(licences, F.array_max(licences)).cast("int") - 1)
    met = met.withColumn("probability", F.get("e", F.col("likeliest")) / F.col("whole"))
    family_of = F.array(*[F.lit(named.index(f)) for f, _ in templates])
    shares = F.transform(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda n: F.when(F.get(family_of, n) == F.col("likeliest"), F.coalesce(F.try_element_at("m", n + classes), F.lit(0.0))).otherwise(0.0))
    sizes = F.array(*[F.lit(len(own)) for _, own in templates])
    # How much of a template and of the window's known n-grams is common to both: other words do not tell a wrapped notice from its lines, those of another licence do.
    likeness = F.transform(shares, lambda x, n: 2 * x * F.get(sizes, n) / (F.col("n") + F.get(sizes, n)))
    met = met.withColumn("similarity", F.array_max(shares)).withColumn("likeness", F.array_max(likeness))
    names = F.array(*[F.lit(f) for f in named])
    met = met.withColumn("family", F.when((F.col("likeliest") < len(named)) & (F.col("probability") >= scanner.threshold), F.get(names, F.col("likeliest"))).otherwise("unknown"))
    met = met.withColumn("confirmed", (F.col("family") != "unknown") & (F.col("similarity") >= CONFIRMED))
    # Confirmed ones first, by their likeness; the others by their lines.
    order = F.struct((~F.col("confirmed")).alias("a"), F.when(F.col("confirmed"), -F.round("likeness", 9)).alias("b"), (F.col("last") - F.col("first")).alias("c"), F.col("first").alias("d"))
    units = met.groupBy("row", "doc_id", "mark", "paragraph").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "first", "last", "family", "probability", "similarity", "confirmed"))).alias("units"))
    notices = units.select("doc_id", "mark", "paragraph", F.inline(_apart(F.col("units"))))
    return notices.drop("order").distinct()


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, n_licences, n_confirmed, families) of every document: its notices; families: the confirmed ones, or unknown, sorted."""
    require(docs, "doc_id", "text")
    found = paragraphs(docs, scanner).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.count("*").alias("n_distinct"),
        F.count(F.when(F.col("confirmed"), 1)).alias("good"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")).otherwise("unknown"))), ",").alias("families"),
    )
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("mark"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["mark"] == found["_mark"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", F.coalesce("n_distinct", zero).alias("n_licences"), F.coalesce("good", zero).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))
