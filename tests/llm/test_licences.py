import re

from gristmill.llm import licences

SCHEMA = "doc_id long, text string, places string, r int"
TEXTS = [
    None,
    "",
    "cc by cc by CC-BY 4.0",
    "All rights\nreserved. all rights reserved all rights",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.",
    "Released under the great License.",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.",
    "généralcc by general public\tlicense Kİ cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "word " * 20000 + "cc by",
    "all all rights reserved",
]


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels


def templates(text):
    """The same rule, tried at every start."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    found = set()
    for e in licences.index():
        if e.base or any(f" {p} " not in f" {' '.join(words)} " for p in e.phrases):
            continue
        for s in range(-20, len(words)):
            if sum(0 <= s + i < len(words) and words[s + i] == w for w, i in e.words) >= e.need * len(e.words):
                found.add(e.label)
    return found


def test_against_brute_force(spark):
    got = licences.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        n, places, first, last, labels = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, places, first, last)
        assert r.base_labels == ",".join(sorted(labels))
        if len(TEXTS[r.doc_id] or "") < 1000:
            assert r.labels == ",".join(sorted(labels | templates(TEXTS[r.doc_id])))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    by = {r.doc_id: r.labels for r in got}
    assert by[4] == "gpl,gpl-3.0" and by[5] == "mit" and by[6] == "" and by[7] == "apache-2.0" and by[8] == "cc-by,cc-by-nc-4.0"


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stray_anchor_words(spark):
    said = "This program is licensed under the GNU General Public License version 3."
    texts = [said + " Other work.", "work " * 3 + said, "Distributed under the MIT License. It was released today.", "word " * 5000 + said + " work" * 50, "released " * 20 + "x " * 3000 + "distributed under the MIT License", "gnu work 3 general public license"]
    got = {r.doc_id: set(r.labels.split(",")) for r in licences.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert ["gpl-3.0" in got[i] for i in (0, 1, 3, 5)] == [True, True, True, False] and "mit" in got[2] and "mit" in got[4]
    for i, t in enumerate(texts):
        assert got[i] - {""} == brute(t)[4] | templates(t)
