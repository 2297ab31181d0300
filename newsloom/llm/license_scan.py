"""Licence scan by Dice coefficient over word bigrams (operator 2, native).

Text is normalised: lower case, runs of anything but letters and digits become
one space. A document's segments are its lines, its paragraphs (separated by
blank lines) and its whole text. A segment and a template are compared by the Dice
coefficient 2 * |A & B| / (|A| + |B|) of their sets of word bigrams; they match
at ``threshold`` (0.8) or more.

Pruning is exact. By size: at threshold t only templates with
t / (2 - t) <= |A| / |B| <= (2 - t) / t can match, so a segment is compared with
no others. Before that by words: a match misses at most floor(|B| * (1 - t / (2 - t)))
of a template's bigrams, so a segment must hold one of any set of words that
covers one bigram more; the cover words of all templates are looked up as
substrings, and only texts that have one are normalised and cut at all.

With ``windows`` (the registered query has it) notices inside running text are
found too: windows over the words of the whole text, of t / (2 - t) to (2 - t) / t
times a template's bigrams. A best window starts and ends with a bigram of the template,
so only such are compared, and only with templates of which the text holds t / (2 - t) of
the bigrams; no other window can match better. Of windows that overlap the best is
taken, then the next best beside it; each licence that no segment has adds its
best window as one hit.

All of it is one projection of built-in functions over the document's own row: no
shuffle, no state, any file layout.

Edges: null and empty texts, texts without two words and texts without a match
have null licence and dice and no hits. Of equal coefficients the template that
stands first wins. Repeated rows and null ids are scanned like any other; columns
besides id and text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

#: Public licence notices as their publishers word them.
TEMPLATES = [
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "This project is licensed under the MIT License."),
    ("MIT", "permissive", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "permissive",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "permissive",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "permissive",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    ("MPL-2.0", "weak copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "GPL-3.0",
        "copyleft",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "share alike", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "share alike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "restricted", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
]
#: Words too common to search for, unless nothing else covers a template.
COMMON = set(
    "a all and any as at be by following for free in is it may no of on or other prior so source that the this to under use version "
    "with without work you".split()
)


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text, in order, normalised as the columns are."""
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def cover_words(sets: list[list[str]], threshold: float) -> list[str]:
    """Words of which every segment that matches a template must have one."""
    spread = Counter(w for s in sets for w in {x for b in s for x in b.split()})
    chosen: list[str] = []
    for s in sets:
        least = (threshold / (2 - threshold) - 1e-9) * len(s)
        need = len(s) - int(-(-least // 1)) + 1  # one more than a match can miss
        left = [b for b in s if not set(b.split()) & set(chosen)]
        have = len(s) - len(left)
        while have < need:
            words = Counter(w for b in left for w in set(b.split()))
            word = max(words, key=lambda w: (w not in COMMON, len(w) > 3, spread[w], words[w], w))
            chosen.append(word)
            left = [b for b in left if word not in b.split()]
            have = len(s) - len(left)
    # a word that holds another is found with it
    return [w for w in chosen if not any(v != w and v in w for v in chosen)]


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")


def _segments(text: Column) -> Column:
    """Normalised lines, paragraphs and whole of a lower-case text, distinct."""
    clean = _clean(text)
    paragraphs = F.transform(F.split(clean, r"\n *\n"), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    parts = F.concat(F.split(clean, "\n"), paragraphs, F.array(F.replace(clean, F.lit("\n"), F.lit(" "))))
    return F.array_distinct(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, " +", " "))))


def _bigrams(segment: Column) -> Column:
    words = F.split(segment, " ")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    # two shifted arrays, so that no element cuts the segment again
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _bigram_set(segment: Column) -> Column:
    return F.array_distinct(_bigrams(segment))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Words of a text that are searched for windows together.
STRETCH = 1024


def _running(text: Column, known: Column, threshold: float, low: float, high: float, largest: int) -> Column:
    """Matching windows (dice, place, kind, start, end) over a lower-case text's words, the best first, none of which overlap.

    Of each licence the best of them is there; where the best ones of all are found, worse ones are not looked at.
    """
    width = int(largest * high) + 1
    whole = F.trim(F.regexp_replace(F.replace(_clean(text), F.lit("\n"), F.lit(" ")), " +", " "))

    def matches(grams: Column, before: Column, t: Column) -> Column:
        def window(start: Column, end: Column) -> Column:
            return _let(
                F.array_distinct(F.slice(grams, start + 1, end - start + 1)),
                lambda w: F.struct(
                    (2.0 * F.size(F.array_intersect(w, t["grams"])) / (F.size(w) + t["n"])).alias("dice"),
                    t["place"].alias("place"),
                    t["kind"].alias("kind"),
                    (-(before + start)).alias("start"),  # of equal windows the first, then the shortest, sorts highest
                    (-(before + end)).alias("end"),
                ),
            )

        def from_start(held: Column) -> Callable[[Column, Column], Column]:
            def run(start: Column, k: Column) -> Column:
                # held positions rise, so the ends in reach are among the next few
                reach = F.slice(held, k + 1, F.ceil(t["n"] * high).cast("int"))
                ends = F.filter(reach, lambda e: (e - start + 1 >= t["n"] * low) & (e - start + 1 <= t["n"] * high))
                return F.filter(F.transform(ends, lambda e: window(start, e)), lambda w: w["dice"] >= threshold)

            return run

        held = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
        return _let(held, lambda h: F.flatten(F.transform(h, lambda s, k: F.when(s < STRETCH, from_start(h)(s, k)).otherwise(F.filter(F.array(window(s, s)), lambda w: F.lit(False))))))

    def in_stretch(grams: Column, before: Column) -> Column:
        near = F.filter(known, lambda t: F.size(F.array_intersect(grams, t["grams"])) >= t["n"] * low)
        return F.flatten(F.transform(near, lambda t: matches(grams, before, t)))

    def found(grams: Column) -> Column:
        # cutting a window out of an array takes as long as the array: so out of stretches, each with the words that windows from it may reach
        starts = F.sequence(F.lit(0), F.floor((F.size(grams) - 1) / STRETCH).cast("int"))
        cut = lambda k: F.slice(grams, k * STRETCH + 1, F.lit(STRETCH + width))
        windows = F.flatten(F.transform(starts, lambda k: _let(cut(k), lambda part: in_stretch(part, k * STRETCH))))
        return F.reverse(F.array_sort(F.when(F.size(grams) > 0, windows).otherwise(F.slice(windows, 1, 0))))

    def apart(windows: Column) -> Column:
        beside = lambda kept, w: ~F.exists(kept, lambda o: (o["start"] >= w["end"]) & (w["start"] >= o["end"]))
        return F.aggregate(windows, F.slice(windows, 1, 0), lambda kept, w: F.when(beside(kept, w), F.concat(kept, F.array(w))).otherwise(kept))

    def best_apart(windows: Column) -> Column:
        # what is kept only depends on better windows: as far down as the first window of the last licence, if that is enough
        kinds = F.transform(windows, lambda w: w["kind"])
        reach = F.array_max(F.transform(F.array_distinct(kinds), lambda k: F.array_position(kinds, k)))
        few = F.slice(windows, F.lit(1), F.coalesce(reach, F.lit(0)).cast("int"))
        enough = lambda kept: F.size(F.array_distinct(F.transform(kept, lambda w: w["kind"]))) == F.size(F.array_distinct(kinds))
        return _let(apart(few), lambda kept: F.when(enough(kept), kept).otherwise(apart(windows)))

    return _let(_let(_bigrams(whole), found), best_apart)


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str, str]] = TEMPLATES,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    windows: bool = False,
) -> DataFrame:
    """doc_id, license, category, dice of the best match, n_hits (segments with a match; with windows also licences in running text only)."""
    sets = [bigrams(t) for _, _, t in templates]
    kinds_of = [n for n, _, _ in templates]
    known = F.array(
        *[
            F.struct(F.lit(-i).alias("place"), F.lit(kinds_of.index(kinds_of[i])).alias("kind"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("grams"))
            for i, b in enumerate(sets)
            if b
        ]
    )
    # a hair wider than the bound, so that rounding prunes no exact match
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    smallest, largest = min(map(len, filter(None, sets))) * low, max(map(len, sets)) * high
    words = cover_words([s for s in sets if s], threshold)

    def best(grams: Column) -> Column:
        near = F.filter(known, lambda t: (F.size(grams) >= t["n"] * low) & (F.size(grams) <= t["n"] * high))
        scored = F.transform(
            near,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])).alias("dice"),
                t["place"].alias("place"),
                t["kind"].alias("kind"),
            ),
        )
        return F.array_max(scored)

    text = F.col("low")
    pieces = F.filter(_segments(text), lambda s: _any_of(s, words) & (F.char_length(s) > 2))
    # no segment with more than `largest` distinct bigrams, or fewer than `smallest`, can match
    sized = F.filter(F.transform(pieces, _bigram_set), lambda g: (F.size(g) >= smallest) & (F.size(g) <= largest))
    hits = F.filter(F.transform(sized, best), lambda b: b["dice"] >= threshold)
    if windows:
        hits = _let(hits, lambda have: _with_running(have, _running(text, known, threshold, low, high, max(map(len, sets))), len(kinds_of)))
    # substring searches over the lower-case text, which is made once: most texts go no further
    low_case = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("low"))
    found = low_case.select("doc_id", F.when(_any_of(text, words), hits).alias("hits"))
    top = F.array_max("hits")
    names, kinds = ([F.lit(t[k]) for t in templates] for k in (0, 1))
    place = (1 - top["place"]).cast("int")
    return found.select(
        "doc_id",
        F.when(top.isNotNull(), F.element_at(F.array(*names), F.coalesce(place, F.lit(1)))).alias("license"),
        F.when(top.isNotNull(), F.element_at(F.array(*kinds), F.coalesce(place, F.lit(1)))).alias("category"),
        top["dice"].alias("dice"),
        F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits"),
    )


def _with_running(hits: Column, windows: Column, kinds: int) -> Column:
    """Hits of segments, and the best window of each licence (of ``kinds``) that they do not have."""

    def added(new: Column) -> Column:
        of_kind = F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), lambda k: F.get(F.filter(new, lambda w: w["kind"] == k), F.lit(0)))
        first = F.filter(of_kind, lambda w: w.isNotNull())
        return F.concat(hits, F.transform(first, lambda w: F.struct(w["dice"].alias("dice"), w["place"].alias("place"), w["kind"].alias("kind"))))

    return _let(F.filter(windows, lambda w: ~F.exists(hits, lambda h: h["kind"] == w["kind"])), added)


def _any_of(column: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(column, F.lit(w))
    return out


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best matching licence of every document."""
    return scan(common.table(spark, sf_dir, "documents"), windows=True)


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(
        f"({i}, {quote(n)}, {quote(c)}, {len(bigrams(t))}, [{', '.join(map(quote, bigrams(t)))}])" for i, (n, c, t) in enumerate(TEMPLATES)
    )
    return rf"""
with t(place, license, category, n, grams) as (values {rows}),
r as (select row_number() over () row, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') clean from documents),
p as (
  select distinct row, trim(regexp_replace(replace(part, chr(10), ' '), ' +', ' ', 'g')) part from (
    select row, unnest(string_split(clean, chr(10))) part from r
    union all select row, unnest(string_split_regex(clean, '\n *\n')) from r
    union all select row, clean from r)),
w as (select row, part, string_split(part, ' ') words from p),
g as (
  select row, part, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) grams from w where len(words) > 1),
s as (
  select row, part, place, license, category, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + n) dice from g, t
  where list_has_any(g.grams, t.grams)),
b as (
  select row, part, max(dice) dice, arg_max(place, dice * 1000000 - place * 0.000001) place from s where dice >= 0.8 group by row, part),
d as (select row, max(dice) dice, count(*) n_hits, arg_max(place, dice * 1000000 - place * 0.000001) place from b group by row)
select r.doc_id, t.license, t.category, d.dice, coalesce(d.n_hits, 0)::int n_hits
from r left join d using (row) left join t on t.place = d.place
"""


OP2_SQL = _sql()
