"""Licence scan with a positional index of rare words.

1. Document frequencies of the licence words are counted over all files; they give the words' IDF.
2. The index holds, for each mandatory phrase of a template (and each base phrase), its ``PROBES`` words of highest IDF with their
   places: postings (word, phrase, place). A file looks up only these words and intersects the postings by relative position: file position
   less place is where the phrase would start. A start that all probes of a phrase (two, where it has more) agree on is a candidate.
3. Only candidates are verified, word for word. A phrase that stands in a file has all its words at their places, so the index
   loses nothing; scattered words of a licence agree on no start and are never compared.
4. A template's label is given when all its mandatory phrases are verified. ``score`` says how much of the template stands
   around a verified phrase, by IDF, at places that agree up to ``SLACK`` inserted or lost words.

The index is a literal of a few hundred postings, so look-up, intersection and verification happen within a file's row: no file is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.llm.tables import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII that is no digit and no letter.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases and labels that the contract names.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Sentences of public licences, and the phrases that must stand in a file.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license",
        ("licensed under the apache license version 2",),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        ("gnu general public license",),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu "
        "lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("subject to the terms of the mozilla public license v 2",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted",
        ("permission to use copy modify and or distribute this software",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software released into the public domain",),
    ),
    "all-rights-reserved": (
        "copyright all rights reserved",
        ("all rights reserved",),
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        ("licensed under cc by nc",),
    ),
}
#: Function words that are no evidence of a licence.
COMMON = frozenset("a and any are as by in into is it may of or or not that the this to with you can be 0".split())

#: Words of a phrase that are looked up, and how many of them must agree on its start.
PROBES, AGREEING = 3, 2
#: Positions of a template's other words may differ by this many inserted or lost words.
SLACK = 4


def phrases() -> list[tuple[str, str | None]]:
    """All phrases of the index: the base phrases, then each template's with its label."""
    return [(p, None) for p in BASE_PHRASES.values()] + [(p, label) for label, (_, keys) in TEMPLATES.items() for p in keys]


def _vocabulary() -> list[str]:
    texts = [text for text, _ in TEMPLATES.values()] + [p for p, _ in phrases()]
    return sorted({word for text in texts for word in text.split()} - COMMON)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NO_WORD), lambda w: w != "")


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF of the licence words over all files: one number for each, so their count is bounded by the templates."""
    held = docs.select(F.explode(F.concat(
        F.array(F.lit("")), F.array_intersect(words_of(whole(text_col)), F.array(*map(F.lit, _vocabulary()))))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    return {word: math.log((total + 1) / (counts.get(word, 0) + 0.5)) for word in _vocabulary()}


def probes(phrase: str, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The phrase's words of highest IDF with their places."""
    places = [(word, at) for at, word in enumerate(phrase.split()) if word not in COMMON]
    return sorted(places, key=lambda x: (-idf[x[0]], x[1]))[:PROBES]


def _struct_array(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))


def _candidates(words: Column, idf: dict[str, float]) -> Column:
    """(phrase, start) that enough probes agree on, in order."""
    index: dict[str, list[tuple[int, int]]] = {}
    needed = []
    for number, (phrase, _) in enumerate(phrases()):
        chosen = probes(phrase, idf)
        needed.append(min(AGREEING, len(chosen)))
        for word, place in chosen:
            index.setdefault(word, []).append((number, place))
    names = sorted(index)
    postings = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(_struct_array(index[n], ("phrase", "place")) for n in names)))
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(names), F.struct(w.alias("word"), i.alias("at")))))
    looked = F.flatten(F.transform(hits, lambda h: F.transform(
        F.element_at(postings, h["word"]), lambda p: F.struct(p["phrase"].alias("phrase"), (h["at"] - p["place"]).alias("start")))))
    least = F.array(*map(F.lit, needed))

    def agreed(found: Column) -> Column:
        # Equal entries lie side by side: the one that many places on is the same.
        return F.array_distinct(F.filter(found, lambda x, i: F.coalesce(F.get(found, (i + F.get(least, x["phrase"]) - 1).cast("int")) == x, F.lit(False))))

    return F.transform(F.array(F.array_sort(looked)), agreed)[0]


def _verified(words: Column, candidates: Column) -> Column:
    """The candidates whose phrase stands there."""
    texts = F.array(*(F.array(*map(F.lit, p.split())) for p, _ in phrases()))
    return F.filter(candidates, lambda c: (c["start"] >= 0) & (F.slice(
        words, F.greatest(c["start"], F.lit(0)) + 1, F.size(F.get(texts, c["phrase"]))) == F.get(texts, c["phrase"])))


def _shares(words: Column, verified: Column, idf: dict[str, float], given: Column) -> Column:
    """Largest share of a given template's IDF that stands around one of its verified phrases."""
    templates, starts = [], []
    for phrase, label in phrases():
        text = TEMPLATES[label][0].split() if label else []
        starts.append(next((i for i in range(len(text)) if text[i:i + len(phrase.split())] == phrase.split()), 0))
        full = sum(idf[w] for w in text if w not in COMMON)
        templates.append([(w, i, idf[w] / full) for i, w in enumerate(text) if w not in COMMON])
    empty = F.array().cast("array<struct<word:string,place:int,share:double>>")
    held = F.array(*(_struct_array(t, ("word", "place", "share")) if t else empty for t in templates))
    labels = F.array(*(F.lit(label) for _, label in phrases()))
    around = F.array(*(F.lit(i) for i in range(-SLACK, SLACK + 1)))

    def share(v: Column) -> Column:
        origin = v["start"] - F.get(F.array(*map(F.lit, starts)), v["phrase"])
        return F.aggregate(F.get(held, v["phrase"]), F.lit(0.0), lambda total, t: total + F.when(
            F.exists(around, lambda q: F.coalesce(F.get(words, (origin + t["place"] + q).cast("int")) == t["word"], F.lit(False))), t["share"]).otherwise(0.0))

    counted = F.filter(verified, lambda v: F.coalesce(F.array_contains(given, F.get(labels, v["phrase"])), F.lit(False)))
    return F.coalesce(F.array_max(F.transform(counted, share)), F.lit(0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_candidates.

    ``score`` is the largest share of a given template's weight (sum of word IDFs) that the file holds at
    agreeing positions, 0 without such a label; ``n_candidates`` counts the starts that were verified. A null or empty text has no words and no labels.
    Repeated rows each get a result; an empty table gives no rows. Other columns are ignored.
    """
    idf = inverse_frequencies(docs, text_col)
    base, known = len(BASE_PHRASES), phrases()
    files = docs.select(F.col(id_col).alias("id"), words_of(whole(text_col)).alias("words"))
    files = files.withColumn("candidates", _candidates(F.col("words"), idf))
    files = files.withColumn("verified", _verified(F.col("words"), F.col("candidates")))
    stands = lambda number: F.exists("verified", lambda v: v["phrase"] == number)
    numbers = {label: [i for i, (_, of) in enumerate(known) if of == label] for label in TEMPLATES}
    files = files.withColumn("own", F.array_compact(F.array(*(
        F.when(reduce(and_, map(stands, at)), F.lit(label)) for label, at in numbers.items()))))
    found = F.array_compact(F.array(*(F.when(stands(i), F.lit(label)) for i, label in enumerate(BASE_PHRASES))))
    places = F.transform(F.filter("verified", lambda v: v["phrase"] < base), lambda v: v["start"])
    return files.select(
        F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.sort_array(found), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(found, F.col("own"))), ",").alias("labels"),
        F.least(F.lit(1.0), _shares(F.col("words"), F.col("verified"), idf, F.col("own"))).alias("score"),
        F.size("candidates").cast("long").alias("n_candidates"),
    )
