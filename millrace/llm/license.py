"""License scans by a positional rare-token index.

Templates (phrases and longer notices) are indexed by word and position. A first pass counts in how many documents
each template word occurs, over all documents. Each notice is then indexed by its own places of highest inverse
document frequency, two more than a match may miss, so that any match has two of them in place. In the second pass
their postings are intersected by relative position (a template start each occurrence implies), and starts that two
agree on are verified: the share of template words in place, and the mandatory key phrase in full.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .textops import ALNUM, Words, blocks, raw

#: Exact phrases: every place where their words stand consecutively counts, under the label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices (fixed values: the licences' own words): label, text, mandatory key phrase.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "deal in the software without restriction",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions in binary form must reproduce",
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
        "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "www apache org licenses license 2 0",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or at your option any later version",
        "general public license as published by the free software foundation either version 3",
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 "
        "of the license or at your option any later version",
        "general public license as published by the free software foundation either version 2",
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "alter it and redistribute it freely",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
        "as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
)


def hashes(text: str) -> list[int]:
    data, off = raw(pa.array([text]))
    return Words(data, off, 0, 1, ALNUM).hash.tolist()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[int, ...]
    key: tuple[int, ...]
    exact: bool


def templates(phrases: dict[str, str], notices) -> list[Template]:
    out = [Template(label, tuple(hashes(p)), tuple(hashes(p)), True) for p, label in phrases.items()]
    return out + [Template(label, tuple(hashes(t)), tuple(hashes(k)), False) for label, t, k in notices]


class Index:
    """Postings (template, position) of the words sought, and the template words' inverse document frequencies."""

    def __init__(self, made: list[Template], frequency: dict[int, int], n_docs: int, least: float = 0.8):
        self.made, self.least = made, least
        words = {w for x in made for w in x.words}
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in words}
        #: An exact phrase is sought by its rarest place; a notice by its rarest places, so many that a match holds
        #: ``votes`` of them whichever words it misses.
        self.postings, self.votes = defaultdict(list), []
        for t, x in enumerate(made):
            rare = sorted(range(len(x.words)), key=lambda q, x=x: (-self.idf[x.words[q]], q))
            spare = 0 if x.exact else sum(k / len(x.words) >= least for k in range(len(x.words)))
            self.votes.append(1 if x.exact else min(2, len(x.words) - spare))
            for q in rare[: spare + self.votes[t]]:
                self.postings[x.words[q]].append((t, q))
        self.vocabulary = np.array(sorted(self.postings), np.uint64)

    def scan(self, words: np.ndarray, at: np.ndarray) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """words: hashes of one file; at: places of those in the vocabulary. Exact places (template, start), and
        scores of the labels found."""
        own = [(int(p), int(words[p])) for p in at]
        base, votes = set(), Counter()
        for p, w in own:
            for t, q in self.postings[w]:
                x = self.made[t]
                if x.exact:
                    if 0 <= p - q <= len(words) - len(x.words):
                        if tuple(words[p - q : p - q + len(x.words)].tolist()) == x.words:
                            base.add((t, p - q))
                else:
                    votes[t, p - q] += 1
        scores: dict[str, float] = {}
        for t, _ in base:
            scores[self.made[t].label] = 1.0
        for (t, start), n in votes.items():
            x = self.made[t]
            if n < self.votes[t]:
                continue
            lo = max(0, start)
            span = words[lo : start + len(x.words)].tolist()
            same = sum(a == b for a, b in zip(span, x.words[lo - start :], strict=False)) / len(x.words)
            if same >= self.least and any(tuple(span[i : i + len(x.key)]) == x.key for i in range(len(span) - len(x.key) + 1)):
                scores[x.label] = max(scores.get(x.label, 0), same)
        return sorted(base), scores


def _frequency(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            data, off = raw(batch.column("text"))
            n += len(off) - 1
            for i, j in blocks(off):
                w = Words(data, off, i, j, ALNUM)
                at = np.searchsorted(vocabulary, w.hash).clip(max=len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hash)
                total += np.bincount(np.unique(w.doc[hit] * len(vocabulary) + at[hit]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary) + 1)), pa.array(np.concatenate((total, [n])))], ["word", "n"])

    return run


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = index.vocabulary
        for batch in batches:
            data, off = raw(batch.column("text"))
            out: list[list] = [[] for _ in range(7)]
            for i, j in blocks(off):
                w = Words(data, off, i, j, ALNUM)
                first = np.concatenate(([0], np.cumsum(w.count)))
                at = np.flatnonzero(v[np.searchsorted(v, w.hash).clip(max=len(v) - 1)] == w.hash)
                cut = np.searchsorted(at, first)
                for d in range(j - i):
                    base, scores = [], {}
                    if cut[d] < cut[d + 1]:
                        base, scores = index.scan(w.hash[first[d] : first[d + 1]], at[cut[d] : cut[d + 1]] - first[d])
                    starts = [s for _, s in base]
                    labels = sorted({index.made[t].label for t, _ in base})
                    row = (int(w.count[d]), len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(sorted(scores)), max(scores.values(), default=0.0))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], NAMES)

    return run


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    Null, empty and wordless texts have no words, no labels (empty strings) and score 0. Rows with equal or null ids
    are scanned each for itself. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    made = templates(phrases, notices)
    vocabulary = np.array(sorted({w for x in made for w in x.words}), np.uint64)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = base.select("text").mapInArrow(_frequency(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    n = {r["word"]: r["n"] for r in counted}
    index = Index(made, {int(w): n.get(k, 0) for k, w in enumerate(vocabulary)}, n.get(len(vocabulary), 0))
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return base.mapInArrow(_scan(index), kinds)
