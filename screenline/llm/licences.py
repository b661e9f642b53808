"""Licence notices in texts: Dice coefficient over word bigrams.

A text's lines, its paragraphs and all windows of a template's length in words are
normalised and compared with the templates. Two sets of a and b bigrams reach a
Dice coefficient t only if a >= b * t / (2 - t) and b >= a * t / (2 - t), so most
units are settled by their size alone. They then also have b * t / (2 - t) bigrams
in common at least, so of one bigram more than may be missing, one is there: a text
without any of these is not compared with that template, and windows start near
them alone. Built-in functions only; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenline.functions.settle import settle

#: A name and the text of one notice or paragraph; a licence may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    """Words of a template, normalised as texts are."""
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip(" ").split(" ")


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams with which a unit can reach the threshold."""
    low, high = size * threshold / (2 - threshold), size * (2 - threshold) / threshold
    return max(1, int(-(-low // 1))), int(high)


def anchors(own: Sequence[str], threshold: float) -> list[str]:
    """So many bigrams of a template that a unit which reaches the threshold holds one of them: the longest, which are rare."""
    least, _ = bounds(len(own), threshold)
    return sorted(own, key=lambda b: (-len(b), b))[:max(0, len(own) - least + 1)]


def find_licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: doc_id, licences (names in the order of the templates), best, best_score, n_units, n_windows.

    A unit is a line, a paragraph, or, for each template, any run of as many words
    as the template has, over line ends too: so a notice is found inside a longer
    line and in a block of comments. `n_units` counts the distinct pairs of a
    matching line's or paragraph's bigrams and a template, `n_windows` the templates
    that some run of words matches. `best` is the name with the highest coefficient,
    the earliest template of equals; null, like `best_score`, if nothing reaches the
    threshold. Null and empty texts match nothing; nor does a template of one word.
    Each row has its own result; ids may repeat or be null; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = [(name, bag, *bounds(len(bag), threshold)) for name, bag in ((n, template_bigrams(t)) for n, t in templates)]
    lengths = [len(template_words(t)) for _, t in templates]
    marks = [anchors(k[1], threshold) for k in known]
    least, most = min(k[2] for k in known), max(k[3] for k in known)

    def strings(of: Sequence[str]) -> Column:
        # one literal; words hold no bar
        return F.split(F.lit("|".join(of)), "[|]") if of else F.array().cast("array<string>")

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))

    def near(i: int) -> Column:
        return F.array_contains("near", F.lit(i))

    low = settle(source.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text")), {"words": plain(F.col("text"))})
    some = F.array(*[F.when(reduce(or_, (F.contains("words", F.lit(a)) for a in m), F.lit(False)), F.lit(i)) for i, m in enumerate(marks)])
    low = settle(low, {"near": F.filter(some, lambda i: i.isNotNull())})
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[ \t]*\n")))
    units = F.when(F.size("near") > 0, units).otherwise(strings([]))
    words = F.transform(units, lambda u: F.split(plain(u), " "))
    words = F.filter(words, lambda w: F.size(w) > least)  # n words have n - 1 bigrams at most

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))

    def scores(bag: Column) -> Column:
        n = F.size(bag)
        return F.array(*[
            F.when(near(i) & n.between(low, high), F.struct(
                (2.0 * F.size(F.array_intersect(bag, strings(own))) / (n + len(own))).alias("score"),
                F.lit(-i).alias("place"), F.lit(name).alias("name")))
            for i, (name, own, low, high) in enumerate(known)])

    def window(i: int) -> Column:
        """The highest coefficient of the windows with a mark of template i; its marks are few in a text, its windows as many times longer."""
        (name, own, _, _), n, all_ = known[i], lengths[i] - 1, F.size("run")
        at = F.filter(F.sequence(F.lit(0), all_ - 1), lambda p: F.array_contains(strings(marks[i]), F.get("run", p)))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.lit(0), p - (n - 1)), F.least(p, all_ - n)))))

        def score(p: Column) -> Column:
            bag = F.slice("run", p + 1, n)
            return 2.0 * F.size(F.array_intersect(bag, strings(own))) / (F.size(F.array_distinct(bag)) + len(own))
        return F.when(near(i) & (all_ >= n), F.struct(F.array_max(F.transform(starts, score)).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))

    found = settle(low, {"run": F.when(F.size("near") > 0, pairs(F.split("words", " "))).otherwise(strings([])), "bags": F.array_distinct(F.transform(
        F.filter(F.transform(words, lambda w: F.array_distinct(pairs(w))), lambda b: F.size(b).between(least, most)), lambda b: F.array_sort(b)))})

    def good(h: Column) -> Column:
        return h.isNotNull() & (h["score"] >= threshold)

    found = settle(found.drop("text", "words"), {
        "units": F.filter(F.flatten(F.transform("bags", scores)), good),
        "windows": F.filter(F.array(*[window(i) for i in range(len(known)) if lengths[i] > 1]), good)})
    found = settle(found.drop("bags", "run"), {"hits": F.concat("units", "windows")})
    names = list(dict.fromkeys(n for n, _ in templates))
    best = F.array_max("hits")  # by score, then the earlier template
    return found.select(
        "doc_id",
        F.filter(F.array(*map(F.lit, names)), lambda n: F.exists("hits", lambda h: h["name"] == n)).alias("licences"),
        best["name"].alias("best"), F.round(best["score"], 6).alias("best_score"), F.size("units").alias("n_units"), F.size("windows").alias("n_windows"))
