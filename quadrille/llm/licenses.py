"""Operator 6: license scan by a positional index of rare words, in DataFrame functions only.

Words are maximal runs of letters, digits and characters beyond ASCII, with A-Z lowered.
Document frequencies of all license words are counted over the whole table; the index holds,
for each template, its ``RARE`` words of highest inverse document frequency with their
places in the template. A document's places of those words, shifted to where the template
would start, are intersected; at each start left the template's mandatory key phrase is
verified word for word. Templates longer than their key also count how many of their words
stand where they should.

``scan`` adds n_words, places (array of template number, label, start and covered share),
and nothing is shuffled but the word counts. Null texts count as empty: no words, no
places. Repeated rows get equal results, an empty table stays empty, columns of the added
names are replaced, and texts are taken whole at any length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 2
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A license text: its words, of which the first ``key`` are mandatory (0: all)."""

    label: str
    text: str
    key: int = 0

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase(self) -> list[str]:
        return self.words[: self.key or None]


# The base phrases.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
# Phrases of public license texts.
OWN = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 6),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 5),
    Template("gpl", "gnu general public license as published by the free software foundation", 4),
    Template("lgpl", "gnu lesser general public license as published by the free software foundation", 5),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", 8),
    Template("mpl-2", "mozilla public license version 2 0", 3),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 9),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words; the Kelvin sign, whose lower case is an ASCII letter, stays beyond ASCII."""
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.filter(F.split(low, SPLIT), lambda w: w != "")


def frequencies(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> dict[str, int]:
    """In how many documents each license word stands; one number per license word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_intersect(words_of(F.col(f"`{text}`")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def rare_words(template: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """(word, place) of the key phrase's words of highest inverse document frequency."""
    phrase = template.phrase
    return sorted(((w, i) for i, w in enumerate(phrase) if phrase.index(w) == i), key=lambda x: (df[x[0]], x[1]))[:RARE]


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + OWN, text: str = "text") -> DataFrame:
    index = {t: rare_words(t, df) for df in [frequencies(docs, templates, text)] for t in templates}
    lookup = sorted({w for found in index.values() for w, _ in found})
    # One rare word of each template is enough to tell that a document needs no further look.
    first = sorted({found[0][0] for found in index.values()})
    at = {w: f"__at_{i}" for i, w in enumerate(lookup)}

    def places(w: str) -> Column:
        every = F.transform(F.col("__words"), lambda x, i: F.when(x == F.lit(w), i))
        return F.when(F.col("__near"), F.filter(every, lambda i: i.isNotNull()))

    def shifted_by(w: str, place: int) -> Column:
        return F.transform(F.col(at[w]), lambda i: i - F.lit(place))

    def verified(number: int, t: Template) -> Column:
        starts = None
        for w, place in index[t]:
            shifted = shifted_by(w, place)
            starts = shifted if starts is None else F.array_intersect(starts, shifted)
        key, words = F.array(*map(F.lit, t.phrase)), t.words
        held = F.filter(starts, lambda s: (s >= 0) & (F.slice(F.col("__words"), F.greatest(s, F.lit(0)) + 1, len(t.phrase)) == key))

        def covered(s: Column) -> Column:
            if len(t.phrase) == len(words):
                return F.lit(1.0)
            same = sum((F.when(F.get(F.col("__words"), s + F.lit(j)) == F.lit(w), 1).otherwise(0) for j, w in enumerate(words)), F.lit(0))
            return same / F.lit(float(len(words)))

        return F.transform(held, lambda s: F.struct(F.lit(number).alias("template"), F.lit(t.label).alias("label"), s.cast("long").alias("start"), covered(s).alias("share")))

    kept = [c for c in docs.columns if c not in ("n_words", "places")]
    out = docs.select(*(F.col(f"`{c}`") for c in kept), words_of(F.col(f"`{text}`")).alias("__words"))
    out = out.withColumn("__near", F.arrays_overlap("__words", F.array(*map(F.lit, first))))
    out = out.select("*", *(places(w).alias(at[w]) for w in lookup))
    found = F.when(F.col("__near"), F.concat(*(verified(i, t) for i, t in enumerate(templates))))
    none = F.array().cast("array<struct<template:int,label:string,start:bigint,share:double>>")
    return out.select(*(F.col(f"`{c}`") for c in kept), F.size("__words").cast("long").alias("n_words"), F.coalesce(found, none).alias("places"))


def summary(scanned: DataFrame, base: int = len(BASE)) -> DataFrame:
    """Per document the base places' number, first and last start, labels and best share; columns of these names are replaced."""
    is_base = F.filter("places", lambda p: p["template"] < base)
    starts = F.transform(is_base, lambda p: p["start"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    made = ("n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return scanned.select(
        *(F.col(f"`{c}`") for c in scanned.columns if c not in made),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
