"""Quotient filters, phrase mining and license scans against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from chronopanel.llm import licenses, phrases, quotient

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("bits,n", [(2, 2), (2, 3), (4, 4), (6, 3), (18, 2), (18, 3), (18, 4), (30, 4), (32, 4)])
def test_filters_are_lossless_and_merge(bits, n):
    rng = np.random.default_rng(bits * n)
    top = min(1 << bits, 1 << 62)
    ids = [np.concatenate([rng.integers(0, top, 400), [0, top - 1, 0]]).astype(np.uint64) for _ in range(n)]
    h = quotient.half_bits(bits, n)
    hi, lo = quotient.packed(ids, bits)
    assert int(hi.max()) < 1 << h and int(lo.max()) < 1 << h
    assert all(np.array_equal(a, b) for a, b in zip(quotient.unpacked(hi, lo, bits, n), ids))
    p = quotient.permuted(hi, lo, h)
    assert all(np.array_equal(a, b) for a, b in zip(quotient.restored(*p, h), (hi, lo)))
    assert int(p[0].max()) < 1 << h and int(p[1].max()) < 1 << h
    want, pieces = Counter(), []
    for _ in range(3):
        take = rng.integers(0, len(hi), 300)
        counts = rng.choice([1, 2, 254, 255, 256, 10**12], 300)
        for k, c in zip(take.tolist(), counts.tolist()):
            want[tuple(int(x[k]) for x in ids)] += c
        entries = quotient.counted(p[0][take], p[1][take], counts, h)
        # Cut by the leading bits, written and read again.
        for prefix in range(1 << min(2, h)):
            own = entries[0] >> np.uint64(h - min(2, h)) == prefix
            if own.any():
                back = quotient.from_filter(quotient.to_filter(*(x[own] for x in entries), h, min(2, h), prefix))
                assert back[3] == h and all(np.array_equal(a, b[own]) for a, b in zip(back[:3], entries))
                pieces.append(back[:3])
    a, b, counts = quotient.counted(*(np.concatenate(x) for x in zip(*pieces)), h)
    got = quotient.unpacked(*quotient.restored(a, b, h), bits, n)
    assert dict(zip(zip(*(x.tolist() for x in got)), counts.tolist())) == want


def brute(docs, least, top):
    """Rows of all languages by counting every phrase."""
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for (lang, *p), g in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                sub = (lang, *p[i : i + m])
                if 100 * g >= 80 * cand[sub]:
                    gone.add(sub)
    rows = []
    for (lang, *p), a in cand.items():
        if (lang, *p) not in gone:
            cuts = [(2000000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, total[lang], -score))
    return out


def texts(rng):
    words = ["the", "The", "of", "état", "x1", "a", "b", "co-op", "日本", "q", " ", "so", "it's", "zz"]
    weights = [9, 3, 8, 3, 3, 5, 5, 2, 2, 1, 1, 4, 2, 1]
    out = []
    for _ in range(400):
        parts = rng.choices(words, weights, k=rng.randrange(0, 40))
        for k in range(0, len(parts), 7):
            parts[k] = rng.choice(["new york city", "of the", parts[k], "a a a"])
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "; "]) for x in parts)))
    return out + [("en", None), ("fr", ""), (None, " .,; "), ("de", "once"), ("en", "of the " * 20_000)]


SCHEMA = "lang string, text string, word string, f int, ids int, key string, id string, rank int"


def table(spark, docs):
    return spark.createDataFrame([(*d, "w", 1, 2, "k", "i", 3) for d in docs], SCHEMA).repartition(5)


@pytest.mark.parametrize("rows,held,places", [(phrases.DICTIONARY_ROWS, phrases.HELD_KEYS, phrases.PAIR_BITS), (0, 50, 64)])
def test_phrases_equal_brute_force(spark, monkeypatch, rows, held, places):
    """By broadcast and by shuffle, with large and with tiny tables."""
    monkeypatch.setattr(phrases, "HELD_KEYS", held)
    monkeypatch.setattr(phrases, "PAIR_BITS", places)
    docs = texts(random.Random(3))
    got = phrases.mine(table(spark, docs), min_count=3, top=40, dictionary_rows=rows).collect()
    want = brute(docs, 3, 40)
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 100


def test_no_phrases(spark):
    docs = table(spark, [("en", None), (None, "once"), ("fr", "")])
    assert phrases.mine(docs).collect() == [] and phrases.mine(docs.limit(0)).collect() == []


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_scan(texts, notices, rare, weight):
    """Every template tried at every place of every text."""
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(LOWER))
        hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        labels, score = {x for _, x in hits}, float(bool(hits))
        base = ",".join(sorted(labels))
        for (label, words, keys), places in zip(notices, rare):
            slack = len(words) // 4
            for at in range(-len(words), len(w)):
                here = [0 <= at + p < len(w) and w[at + p] == x for p, x in enumerate(words)]
                lo, hi = max(0, at - slack), min(len(w), at + len(words) + slack)
                near = all(any(w[i : i + len(k)] == k for i in range(lo, hi - len(k) + 1)) for k in keys)
                if sum(here[p] for p in places) >= max(len(places) - 1, min(len(places), 2)) and near:
                    labels.add(label)
                    score = max(score, sum(weight[x] for x, y in zip(words, here) if y) / sum(weight[x] for x in words))
        at = [i for i, _ in hits]
        out.append((len(w), len(hits), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), round(min(score, 1), 9)))
    return out


def test_licenses_equal_a_search_at_every_place(spark, odd_rows):
    rng = random.Random(8)
    notices = licenses.templates()
    filler = ["the", "License", "a", "of", "under", "software", "code", "MIT", "2", "0", "version", "public", "grüße"]
    rows = [t for _, t in odd_rows if t is None or len(t) < 10_000]
    for k in range(300):
        text = rng.choices(filler, k=rng.randrange(30))
        for _ in range(rng.randrange(3)):
            piece = list(rng.choice(notices)[1]) if rng.random() < 0.8 else rng.choice(licenses.BASE)[0].split()
            for _ in range(rng.randrange(3)):
                p = rng.randrange(len(piece))
                piece[p : p + rng.randrange(2)] = [rng.choice(filler)][: rng.randrange(2)]
                piece = piece or ["x"]
            spot = rng.randrange(len(text) + 1)
            text[spot:spot] = [x.upper() if rng.random() < 0.2 else x for x in piece]
        rows.append("".join(x + rng.choice([" ", ", ", "\n# ", "-", ". "]) for x in text))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    scanner = licenses.fit(docs)
    seen = Counter(w for t in rows for w in set(WORD.findall((t or "").translate(LOWER))))
    weight = {w: np.log((len(rows) + 1) / (seen[w] + 1)) + 1 for _, words, _ in notices for w in words}
    rare = [sorted(range(len(words)), key=lambda p: (-weight[words[p]], p))[: licenses.RARE] for _, words, _ in notices]
    assert scanner.rare == rare
    got = {r.doc_id: (*tuple(r)[1:-1], round(r.score, 9)) for r in licenses.scan(docs, scanner).collect()}
    want = dict(enumerate(brute_scan(rows, notices, rare, weight)))
    assert got == want
    assert len({x[5] for x in want.values()}) > 30


def test_licenses_of_known_lines_and_odd_rows(spark, odd_docs, odd_rows, no_docs):
    lines = {
        "Released under the MIT License.": ("mit", "mit"), "Licensed under CC BY-NC 4.0.": ("cc-by-nc", "cc-by-nc"),
        "Licensed under the Apache License, Version 2.0.": ("apache-2", "apache-2"), "This work is licensed under the GNU General Public License, version 3.": ("", "gpl-3"),
        "// SPDX-License-Identifier: BSD-3-Clause": ("", "bsd-3-clause"), "The license of the public domain, in general: version 3 of it.": ("", ""),
    }
    docs = spark.createDataFrame([(k, f"some text\n{x}\nmore") for k, x in enumerate(lines)], "doc_id bigint, text string")
    got = {r.doc_id: (r.base_labels, r.labels) for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert [got[k] for k in range(len(lines))] == list(lines.values())
    rows = licenses.scan(odd_docs, licenses.fit(odd_docs)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted((i or 0, len(WORD.findall((t or "").translate(LOWER)))) for i, t in odd_rows)
    assert {(r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in rows} == {(0, None, "", "", 0.0)}
    assert licenses.scan(no_docs, licenses.fit(no_docs)).collect() == []
