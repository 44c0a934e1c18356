"""Licence scan by a positional index of rare words.

The index holds, for each licence template, its rarest words (highest IDF over the templates) with their positions. In
a file, the rarest words of a template (as many as no match can be without) are looked up; each of their places gives a
start at which the template may stand, and the share of all its indexed words found at their relative positions is the
start's support. A template is reported where the support is high enough and all its mandatory key phrases occur. Base phrases
are templates whose words must all be in place. Only DataFrame functions are used, in one pass and without a shuffle.

Defined results: a null text counts as empty; an empty text has no words, null places, empty labels and the score 0.0;
every row is scanned on its own, so repeated rows and null ids are of no matter.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening or operative words of well-known licences, label -> (words, mandatory key phrases).
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license",)),
    "apache-2.0-notice": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ("compliance with the license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "associated documentation files")),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
}
INDEXED = 8
LEAST_SUPPORT = 0.75
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Entry(NamedTuple):
    label: str
    words: tuple[tuple[str, int], ...]  #: (word, position), rarest first
    phrases: tuple[str, ...]
    need: float
    base: bool


def index(templates=TEMPLATES, base=BASE, indexed: int = INDEXED, need: float = LEAST_SUPPORT) -> list[Entry]:
    """The postings of each template's rarest words; a word that a template repeats is indexed at its first place."""
    texts = {label: words for label, (words, _) in templates.items()} | {f"={label}": phrase for phrase, label in base.items()}
    df = Counter(w for t in texts.values() for w in set(t.split()))
    rare = lambda w: (-math.log(len(texts) / df[w]), -len(w), w)
    found = []
    for label, text in texts.items():
        words, whole = text.split(), label[0] == "="
        keys = sorted(set(words), key=rare)
        places = [(w, words.index(w)) for w in (keys if whole else keys[:indexed])]
        if whole:
            places += [(w, i) for i, w in enumerate(words) if words.index(w) != i]
        found.append(Entry(label.lstrip("="), tuple(places), () if whole else templates[label][1], 1.0 if whole else need, whole))
    return found


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def normalised(text: Column) -> Column:
    """The words in lower case (A-Z only), each with a space before it, and a space at the end.

    lower() would make ASCII letters of the Kelvin sign and the dotted capital I; they are put out of its reach.
    """
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00ea")), F.lit("\u0130"), F.lit("\u00ea"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(kept), BREAK, " ")), F.lit(" "))


def _places(words: Column, text: Column, entry: Entry) -> Column:
    """Starts (array<struct<support double, start int>>) where the entry stands in words."""
    tried = entry.words[: len(entry.words) - math.ceil(entry.need * len(entry.words)) + 1]  # one of them is in any match
    has = lambda w: F.contains(text, F.lit(f" {w} "))
    place: dict[str, int] = dict(tried)
    word = F.lit(False)
    for w in place:
        word = word | has(w)

    def offset(w: Column) -> Column:
        found = F.lit(None).cast("int")
        for x, i in place.items():
            found = F.when(w == x, i).otherwise(found)
        return found

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(list(place)))
    hit = lambda s: sum((F.when(F.get(words, s + F.lit(i)) == w, 1).otherwise(0) for w, i in entry.words), F.lit(0))
    starts = F.array_distinct(F.transform(found, lambda i: i - offset(F.get(words, i))))
    placed = F.transform(starts, lambda s: F.struct((hit(s) / len(entry.words)).alias("support"), s.alias("start")))
    placed = F.filter(placed, lambda x: (x["support"] >= entry.need) & ((x["start"] >= 0) if entry.base else F.lit(True)))
    none = F.array().cast("array<struct<support:double,start:int>>")
    ready = word
    for phrase in entry.phrases:
        ready = ready & F.contains(text, F.lit(f" {phrase} "))
    return F.when(ready, placed).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries: list[Entry] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places (of all labels) per row."""
    entries = index() if entries is None else entries

    def of(text: Column) -> Column:
        gaps = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
        n_words = F.when(text == "  ", 0).otherwise(gaps - 1).cast("long")
        keys = sorted({w for e in entries for w, _ in e.words[: len(e.words) - math.ceil(e.need * len(e.words)) + 1]})
        any_key = F.lit(False)
        for w in keys:
            any_key = any_key | F.contains(text, F.lit(f" {w} "))
        places = lambda words: F.array(*(F.struct(F.lit(e.label).alias("label"), F.lit(e.base).alias("base"), _places(words, text, e).alias("at")) for e in entries))
        none = F.array().cast("array<struct<label:string,base:boolean,at:array<struct<support:double,start:int>>>>")
        hits = F.when(any_key, _let(F.split(F.trim(text), " "), lambda words: F.filter(places(words), lambda e: F.size(e["at"]) > 0))).otherwise(none)
        return F.struct(n_words.alias("n_words"), hits.alias("hits"))

    rows = docs.select(F.col(id_col).alias("doc_id"), _let(normalised(F.col(text_col)), of).alias("r"))
    base = F.filter(F.col("r.hits"), lambda e: e["base"])
    starts = F.flatten(F.transform(base, lambda e: F.transform(e["at"], lambda p: p["start"])))
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda e: e["label"]))), ",")
    best = F.array_max(F.flatten(F.transform(F.col("r.hits"), lambda e: F.transform(e["at"], lambda p: p["support"]))))
    return rows.select(
        "doc_id",
        F.col("r.n_words").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("r.hits")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        F.col("r.hits").alias("places"),
    )
