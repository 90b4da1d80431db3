"""License scan: an exact set-similarity join of text blocks with license templates. DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Templates of the method: (label, text). A block holds one if it has `CONTAINED` of its distinct words.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced or transmitted in any form without prior written permission"),
)
CONTAINED = 0.9


def words_of(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def frequencies(docs: DataFrame, text_col: str, templates=TEMPLATES) -> dict[str, int]:
    """Number of documents with each word of the templates: as many rows as the templates have words, whatever docs hold."""
    vocab = F.array(*map(F.lit, vocabulary(templates)))
    rows = docs.select(F.explode(F.array_intersect(vocab, words_of(F.col(text_col).cast("string")))).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def window_of(template: str, contained: float) -> int:
    """Words in which a template may stand with others between its own."""
    return math.ceil(len(template.split()) / contained - 1e-9)


def license_scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """docs with _lx_words, _lx_starts, _lx_base, _lx_found (labels) and _lx_score.

    Base: PHRASES whose words stand consecutively in the whole text give _lx_starts (word positions from 0, ascending)
    and _lx_base. Method: text blocks are windows of words over the whole text, wherever its lines break: for a template
    of n words, w = ceil(n / contained), blocks of 2 w words begin every w words, so each run of w words lies in one. A
    block's distinct words are a set; it holds a template if it has need = ceil(contained * |template|) of its distinct
    words. Template words are ordered by their frequency in the whole corpus, rarest first. An index from the first
    |template| - need + 1 words of the templates (prefix filter) to the templates gives the ones that a text may hold at
    all. Of a block, two of the first |template| - need + 2 words must be there (positional filter: no more than
    |template| - need words before the second shared one may be missing) and at least need words (length filter). What
    passes is intersected exactly. _lx_found has the base labels and those of the templates; _lx_score is 1 with a base
    phrase, else the largest containment that reached the threshold, else 0.

    The join runs inside each row, against the index and templates as literals: after one aggregate of a few hundred
    words there is no shuffle at all, and no key can be hot. A null or empty text has no words, labels or places and
    score 0. Ids are not looked at, so rows may repeat; other columns are passed on, those named like an output give way
    to it. An empty table gives no rows.
    """
    count = frequencies(docs, text_col, templates)
    rank = {w: i for i, w in enumerate(sorted(vocabulary(templates), key=lambda w: (count.get(w, 0), w)))}
    rules, index = [], {}
    for t, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=rank.get)
        need = math.ceil(contained * len(own) - 1e-9)
        rules.append((label, own, need, window_of(text, contained)))
        for w in own[: len(own) - need + 1]:
            index.setdefault(w, []).append(t)
    docs = without(docs, "_lx_words", "_lx_starts", "_lx_base", "_lx_found", "_lx_score")
    all_words, rare_words, held_by = fresh("words"), fresh("rare"), fresh("held")
    rare = F.array(*map(F.lit, sorted(index)))
    d = docs.withColumn(all_words, words_of(F.col(text_col).cast("string")))
    d = d.withColumn("_lx_words", F.size(all_words).cast("long"))

    def starts(words: Column) -> Column:
        def here(i: Column) -> Column:
            return _any([_all([F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())]) for phrase, _ in PHRASES])

        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)

    spaced = F.concat(F.lit(" "), F.array_join(all_words, " "), F.lit(" "))
    empty = F.array().cast("array<int>")
    some = _any([F.array_contains(all_words, p.split()[0]) for p, _ in PHRASES])
    d = d.withColumn("_lx_starts", F.when(some, starts(F.col(all_words))).otherwise(empty))
    base = F.when(F.size("_lx_starts") > 0, F.filter(F.array(*(F.when(F.contains(spaced, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES)), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_lx_base", base)
    d = d.withColumn(rare_words, F.array_intersect(rare, F.col(all_words)))
    find = F.create_map(*(x for w in sorted(index) for x in (F.lit(w), F.array(*map(F.lit, index[w])))))
    known = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, own)).alias("own"), F.lit(need).alias("need"), F.lit(w).alias("w")) for label, own, need, w in rules))

    def held(t: Column) -> Column:
        """(label, containment) of the blocks that hold a template."""
        x, words = F.element_at(known, t + 1), F.col(all_words)
        begins = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / x["w"]).cast("int") - 1, F.lit(0)))
        first = F.slice(x["own"], 1, F.size(x["own"]) - x["need"] + 2)
        blocks = F.transform(begins, lambda k: F.slice(words, k * x["w"] + 1, x["w"] * 2))
        blocks = F.filter(blocks, lambda b: (F.size(b) >= x["need"]) & (F.size(F.array_intersect(first, b)) >= F.least(F.lit(2), x["need"])))
        shared = F.filter(F.transform(blocks, lambda b: F.size(F.array_intersect(x["own"], b))), lambda n: n >= x["need"])
        return F.transform(shared, lambda n: F.struct(x["label"].alias("label"), (n / F.size(x["own"])).alias("part")))

    nothing = F.array().cast("array<struct<label:string,part:double>>")
    candidates = F.array_distinct(F.flatten(F.transform(rare_words, lambda w: F.element_at(find, w))))
    d = d.withColumn(held_by, F.when(F.size(rare_words) > 0, F.flatten(F.transform(candidates, held))).otherwise(nothing))
    score = F.when(F.size("_lx_starts") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(held_by, lambda x: x["part"])), F.lit(0.0)))
    d = d.withColumn("_lx_score", score.cast("double")).withColumn("_lx_found", F.array_sort(F.array_union("_lx_base", F.transform(held_by, lambda x: x["label"]))))
    return d.drop(all_words, rare_words, held_by)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
