"""Licence scans by a positional index of rare words. DataFrame functions only.

Every template posts its rarest words, by the corpus's document frequencies, with their places. A file looks up every posted word that it
holds; each place of one, less the place in a template, says where that template would begin. There the template's other rare words must stand at the
same relative places, its key phrase is verified word for word, and the rest is compared. All of it happens within the row.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidespine.llm.common import GAP, lower_ascii
from tidespine.llm.spans import once

#: Label and phrase of the base.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Label, mandatory key phrase, and a template's notice around it.
TEMPLATES = [
    ("mit", "released under the mit license", "Released under the MIT License."),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "under the apache license version 2 0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gnu general public license", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "permission to use copy modify and or distribute this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "licensed under cc by 4 0", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "licensed under cc by sa 4 0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "licensed under cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    ("reserved", "all rights reserved", "All rights reserved."),
]


@dataclass(frozen=True)
class Settings:
    """``indexed``: rare words posted for a template, all of their places in a file looked up;
    ``aligned``: words of a template that must stand in their places (its rare words, or all if it has fewer); ``least_share``: least idf share of the template."""

    indexed: int = 4
    aligned: int = 2
    least_share: float = 0.5


def split_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def words_column(text: Column) -> Column:
    """Words of a text, null as empty. Only the first and last piece of a split can be empty."""
    def trim(parts: Column) -> Column:
        first = F.when(F.get(parts, 0) == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    return once(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP, -1), trim)


def strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def inverse_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """IDF of the templates' words over all documents; the driver gets one number for each word."""
    total = docs.count()
    rows = docs.select(F.explode(F.array_intersect(strings(vocabulary), words_column(F.col(text)))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in rows}
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def scan(docs: DataFrame, idf: dict[str, float], phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES, text: str = "text",
         settings: Settings = Settings()) -> DataFrame:
    """``docs`` with a struct ``licences``: n_words, places (array of (at, label) of the base phrases), found (array of (at, label, share): verified templates).

    Words are runs as in ``common.WORD`` after lower-casing A-Z; places count words from 0. A null or empty text has no words. The share is the idf share of the
    template's words that stand in their places. Nothing is shuffled, and rows depend on their texts and ``idf`` alone; a column named ``licences`` is replaced.
    """
    known = []
    for label, key, notice in templates:
        words, key_words = split_words(notice), split_words(key)
        at = next(i for i in range(len(words)) if words[i:i + len(key_words)] == key_words)
        rare = sorted(dict.fromkeys(words), key=lambda w: (-idf[w], w))[:settings.indexed]
        known.append((label, words, at, len(key_words), rare))
    index = sorted({w for _, words, at, n, rare in known for w in [*rare, *words[at:at + n]]}, key=lambda w: (-idf[w], w))

    def begins(ws: Column, k: int) -> Column:
        """Places where template ``k`` is verified to begin, from each place of each of its posted words."""
        label, words, key_at, key_n, posted = known[k]
        anchors = [(words.index(w), w) for w in posted]
        share = sum(idf[w] for w in words)

        def aligned(at: Column) -> Column:
            return sum((F.when(F.get(ws, at + p) == w, 1).otherwise(0) for p, w in anchors), F.lit(0))

        def key_stands(at: Column) -> Column:
            out = F.lit(True)
            for p in range(key_at, key_at + key_n):
                out = out & F.coalesce(F.get(ws, at + p) == words[p], F.lit(False))
            return out

        def weight(at: Column) -> Column:
            return F.least(F.lit(1.0), sum((F.when(F.get(ws, at + p) == w, idf[w]).otherwise(0.0) for p, w in enumerate(words)), F.lit(0.0)) / share)

        hits = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(posted))
        votes = F.flatten(F.transform(hits, lambda h: F.filter(F.array(*[F.when(h["w"] == w, h["i"] - p) for p, w in anchors]), lambda at: at.isNotNull())))
        need = min(settings.aligned, len(anchors))
        # a template may begin before the file does, but its key phrase may not
        sure = F.filter(F.array_distinct(votes), lambda at: (at + key_at >= 0) & (aligned(at) >= need) & key_stands(at) & (weight(at) >= settings.least_share))
        return F.transform(sure, lambda at: F.struct((at + key_at).alias("at"), F.lit(label).alias("label"), weight(at).alias("share")))

    found_type = "array<struct<at:int,label:string,share:double>>"

    def look(ws: Column) -> Column:
        held = F.array_intersect(strings(index), ws)  # in order of the index: rarest first
        places = []
        for label, phrase in phrases:
            places.append(phrase_places(ws, label, split_words(phrase)))

        def may_stand(r: Column, k: int) -> Column:
            """A posted word is there, and all of the key phrase's words, which verification asks for."""
            _, words, at, n, posted = known[k]
            out = F.arrays_overlap(r, strings(posted))
            for w in dict.fromkeys(words[at:at + n]):
                out = out & F.array_contains(r, w)
            return out

        found = once(held, lambda r: F.concat(*[F.when(may_stand(r, k), begins(ws, k)).otherwise(F.array().cast(found_type)).cast(found_type) for k in range(len(known))]))
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.concat(*places).alias("places"), found.alias("found"))

    return docs.withColumn("licences", once(words_column(F.col(text)), look))


def phrase_places(ws: Column, label: str, phrase: list[str]) -> Column:
    """Places where all words of ``phrase`` stand one after another, found from its last word."""
    def stands(at: Column) -> Column:
        out = at >= 0
        for k, w in enumerate(phrase[:-1]):
            out = out & F.coalesce(F.get(ws, at + k) == w, F.lit(False))
        return out

    ends = F.filter(F.transform(ws, lambda w, i: F.when(w == phrase[-1], i - (len(phrase) - 1))), lambda at: at.isNotNull())
    full = F.transform(F.filter(ends, stands), lambda at: F.struct(at.alias("at"), F.lit(label).alias("label")))
    return F.when(F.array_contains(ws, phrase[-1]), full).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def vocabulary(templates: list[tuple[str, str, str]] = TEMPLATES) -> list[str]:
    return sorted({w for _, _, notice in templates for w in split_words(notice)})
