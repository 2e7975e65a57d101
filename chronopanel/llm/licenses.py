"""License scans: a positional index of rare words finds license notices, key phrases confirm them.

Templates are notices as word sequences with mandatory key phrases.  Their words'
document frequencies are counted over the whole corpus; each template's rarest
`RARE` places enter the index, word to (template, place).  A file looks up those of
its words that the index has, each posting gives the place where the template would
begin, and postings that agree on it are intersected by counting.  Where all but one of the
rare places agree, the key phrases must stand word for word inside the notice's reach.
So common words are never looked up and no text is compared with all templates.

Base phrases are sought word for word in the same pass; their labels always stay.
Memory per task: the templates and one chunk of text.  No shuffle but that of the
frequencies, one row per word of the templates and task.

Defined results: null and empty texts have no words, no places and no labels;
words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in lower-cased A-Z; null ids stay
null; repeated rows give repeated rows; other columns are not read; a corpus
without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import spans

#: Fixed phrases and labels of the base.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Rare places of a template in the index.
RARE = 4

#: Fixed texts: (label, notice as its license words it, key phrases that it must hold).
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "licensed under the MIT License", ("mit license",)),
    ("mit", "released under the MIT License", ("mit license",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("apache license version 2 0", "except in compliance with the license")),
    ("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ("gnu lesser general public license", "version 2 1 of the license")),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu lesser general public license", "version 3 of the license")),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license", "version 3 of the license")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0", "has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal", ("waived all copyright and related or neighboring rights",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages",)),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
)


def _words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def templates() -> list[tuple[str, list[str], list[list[str]]]]:
    """(label, words, key phrases) of all notices, and of those that follow a rule."""
    out = [(label, _words(text), [k.split(" ") for k in keys]) for label, text, keys in NOTICES]

    def add(label: str, text: str, key: str):
        out.append((label, _words(text), [_words(key)]))

    for version in ("2", "3"):
        for name, label in (("", "gpl"), ("Lesser ", "lgpl"), ("Affero ", "agpl")):
            add(f"{label}-{version}", f"licensed under the GNU {name}General Public License, version {version}", f"gnu {name}general public license version {version}")
    # Creative Commons: each set of conditions by its long and its short name.
    for short, conditions in (("by", ""), ("by-sa", "ShareAlike"), ("by-nd", "NoDerivatives"), ("by-nc", "NonCommercial"), ("by-nc-sa", "NonCommercial ShareAlike"), ("by-nc-nd", "NonCommercial NoDerivatives")):
        add(f"cc-{short}", f"licensed under a Creative Commons Attribution {conditions} 4.0 International License", f"attribution {conditions} 4 0 international")
        add(f"cc-{short}", f"licensed under CC {short} 4.0", f"cc {short} 4 0")
    for name, label in (("MIT", "mit"), ("Apache-2.0", "apache-2"), ("GPL-2.0", "gpl-2"), ("GPL-3.0", "gpl-3"), ("LGPL-2.1", "lgpl-2.1"), ("LGPL-3.0", "lgpl-3"), ("AGPL-3.0", "agpl-3"), ("BSD-3-Clause", "bsd-3-clause"), ("ISC", "isc"), ("MPL-2.0", "mpl-2"), ("Unlicense", "unlicense"), ("CC0-1.0", "cc0"), ("Zlib", "zlib"), ("BSL-1.0", "boost-1"), ("EPL-2.0", "epl-2")):
        add(label, f"SPDX-License-Identifier: {name}", f"spdx license identifier {name}")
    return out


_INNER = np.ones(256, bool)
_INNER[128:] = False
_INNER[0x30:0x3A] = False
_INNER[0x61:0x7B] = False


def word_codes(texts: pa.Array, lexicon: spans.Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon's number of every word, -1 for others, and each text's first word."""
    raw, offsets = spans.text_buffer(texts)
    raw = spans.lowered(raw)
    starts, ends, first = spans.word_spans(raw, offsets, _INNER)
    return lexicon.find(raw, starts, ends), first


def _places(codes: np.ndarray, doc: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after another in one text, in order."""
    n, k = len(codes), len(phrase)
    if n < k:
        return np.zeros(0, np.int64)
    ok = doc[: n - k + 1] == doc[k - 1 :]
    for j, c in enumerate(phrase):
        ok &= codes[j : n - k + 1 + j] == c
    return np.flatnonzero(ok)


class Scanner:
    """Templates by number of word, their rare places, and the index from word to (template, place)."""

    def __init__(self, notices: list[tuple[str, list[str], list[list[str]]]], base: tuple[tuple[str, str], ...] = BASE):
        self.notices, self.base = notices, base
        vocabulary = sorted({w for _, words, keys in notices for w in words + sum(keys, [])} | {w for text, _ in base for w in text.split(" ")})
        number = {w: k for k, w in enumerate(vocabulary)}
        self.lexicon = spans.Lexicon([w.encode() for w in vocabulary])
        self.words = [np.array([number[w] for w in words]) for _, words, _ in notices]
        self.keys = [[[number[w] for w in key] for key in keys] for _, _, keys in notices]
        self.phrases = [[number[w] for w in text.split(" ")] for text, _ in base]
        self.reach = max(map(len, self.words))

    def weigh(self, n_docs: int, found: dict[int, int]) -> Scanner:
        """Set the weights by document frequency, and index every template's rarest places."""
        seen = np.array([found.get(k, 0) for k in range(len(self.lexicon.hashes))], float)
        self.weight = np.log((n_docs + 1) / (seen + 1)) + 1
        self.rare = [sorted(range(len(w)), key=lambda p, w=w: (-self.weight[w[p]], p))[:RARE] for w in self.words]
        self.need = np.array([max(len(r) - 1, min(len(r), 2)) for r in self.rare])
        postings = sorted((int(self.words[t][p]), t, p) for t, places in enumerate(self.rare) for p in places)
        table = np.array(postings, np.int64).reshape(-1, 3)
        self.bounds = np.searchsorted(table[:, 0], np.arange(len(seen) + 1))
        self.template, self.place = table[:, 1], table[:, 2]
        return self

    def candidates(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, word where it would begin, text) on which enough rare places agree; the begin may lie before the text."""
        at = np.flatnonzero(codes >= 0)
        at = at[self.bounds[codes[at] + 1] > self.bounds[codes[at]]]
        slots, many = spans.gathered(np.arange(len(self.place)), self.bounds, codes[at])
        word = np.repeat(at, many)
        template, begin = self.template[slots], word - self.place[slots] + self.reach
        key = (doc[word] * len(self.words) + template) * (len(codes) + self.reach + 1) + begin
        _, first, votes = np.unique(key, return_index=True, return_counts=True)
        enough = votes >= self.need[template[first]]
        return template[first][enough], begin[first][enough] - self.reach, doc[word][first][enough]

    def scan(self, codes: np.ndarray, first: np.ndarray) -> dict[str, list]:
        """Base places and labels, all labels and scores of every text of a chunk."""
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        places, low, high = np.zeros(n, np.int64), np.full(n, len(codes), np.int64), np.full(n, -1, np.int64)
        labels: list[set] = [set() for _ in range(n)]
        for phrase, (_, label) in zip(self.phrases, self.base):
            at = _places(codes, doc, phrase)
            own = doc[at]
            np.add.at(places, own, 1)
            np.minimum.at(low, own, at - first[own])
            np.maximum.at(high, own, at - first[own])
            for d in np.unique(own).tolist():
                labels[d].add(label)
        base = [",".join(sorted(x)) for x in labels]
        score = (places > 0).astype(float)
        template, begin, own = self.candidates(codes, doc)
        for t in np.unique(template).tolist():
            mine = template == t
            at, d, words = begin[mine], own[mine], self.words[t]
            # A notice may be a quarter longer or shifted by as much.
            slack = len(words) // 4
            lo, hi = np.maximum(first[d], at - slack), np.minimum(first[d + 1], at + len(words) + slack)
            whole = np.ones(len(at), bool)
            for key in self.keys[t]:
                stands = _places(codes, doc, key)
                slot = np.searchsorted(stands, lo)
                whole &= (slot < len(stands)) & (np.append(stands, len(codes))[slot] + len(key) <= hi)
            share = np.zeros(len(at))
            for p, c in enumerate(words.tolist()):
                here = at + p
                inside = (here >= first[d]) & (here < first[d + 1])
                share += self.weight[c] * (inside & (codes[np.clip(here, 0, len(codes) - 1)] == c))
            share /= self.weight[words].sum()
            for k in np.flatnonzero(whole).tolist():
                labels[d[k]].add(self.notices[t][0])
                score[d[k]] = max(score[d[k]], share[k])
        none = places == 0
        return {
            "n_words": np.diff(first), "n_base": places, "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
            "base_labels": base, "labels": [",".join(sorted(x)) for x in labels], "score": np.minimum(score, 1.0),
        }


def fit(docs: DataFrame, text_col: str = "text", notices: list | None = None) -> Scanner:
    """A scanner weighted by the document frequencies of its words in the whole corpus."""
    scanner = Scanner(templates() if notices is None else notices)
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(scanner.lexicon.hashes)
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                codes, first = word_codes(part.column(0), scanner.lexicon)
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                known = codes >= 0
                seen[:size] += np.bincount(np.unique(doc[known] * size + codes[known]) % size, minlength=size)
                seen[size] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(seen)], ["word", "n"])

    # One row per word of the templates.
    found = {r["word"]: r["n"] for r in rows.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return scanner.weigh(found.get(len(scanner.lexicon.hashes), 0), found)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every text; no shuffle."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                got = scanner.scan(*word_codes(part.column(1), scanner.lexicon))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c in names)], ["doc_id", *names])

    kinds = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return rows.mapInArrow(run, kinds)
