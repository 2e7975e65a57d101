"""Repetition, language-model scores and SimHash against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chronopanel.llm import components, lm_score, repetition, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_counts(text):
    w = WORD.findall(text or "")
    n, seen, covered, longest = len(w), {}, set(), 0
    for i in range(n - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p for i in places for p in range(i, i + 8)}
    while longest < n:
        grams = [tuple(w[i : i + longest + 1]) for i in range(n - longest)]
        if len(set(grams)) == len(grams):
            break
        longest += 1
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), longest


def test_repetition_counts():
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "a", "a " * 13, "x\nx\n x\n", "a b " * 40, "é b c\x0bd\x1ce", "#a *b %%"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["a b", "c", " ", ""]) for _ in range(9)) for _ in range(40)]
    got = repetition.measure(pa.array(texts, pa.string()), 5)
    for k, t in enumerate(texts):
        assert brute_counts(t) == tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")), t


def test_repetition_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = repetition.rules(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted((i or 0, len(WORD.findall(t or ""))) for i, t in odd_rows)
    assert {r.kept for r in rows if r.doc_id in (1, 2, 5)} == {False}
    assert repetition.rules(no_docs).collect() == []


def test_long_copy_inside_a_text_is_rejected(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**9)}" for _ in range(1000)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[100:160])), (3, " ".join(words + words[100:140]))]
    kept = {r.doc_id: r.kept for r in repetition.rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1: True, 2: False, 3: True}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_language_model_base_is_exact_and_both_ways_agree(spark, odd_docs, odd_rows, limit):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    scored = lm_score.score(odd_docs, F.coalesce(train, F.lit(True)), broadcast_bytes=limit).collect()
    count = Counter()
    for i, t in odd_rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(tokens(t))
    total, kinds = sum(count.values()), len(count)
    want = sorted((i or 0, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t)), 4)) for i, t in odd_rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored) == want
    assert all(math.isfinite(r.score) for r in scored)


def test_scores_equal_a_count_table_over_several_segments(spark, monkeypatch):
    """The whole filter and segments one by one give the same scores, those of the quantised counts but for rare false positives."""
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(lm_score, "HELD_KEYS", 100)
    rng = random.Random(16)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(80))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    one, two = ({r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") % 3 != 0, broadcast_bytes=limit).collect()} for limit in (1 << 28, 0))
    assert one == two
    single, pair = Counter(), Counter()
    for i, t in enumerate(texts):
        if i % 3:
            w = tokens(t)
            single.update(w)
            pair.update(zip(w, w[1:]))
    at = lm_score.level_counts(1.5)
    table = lambda c, x: at[lm_score.level_of(np.array([c[x]]), 1.5)[0]] if c[x] else 0.0
    floor = sum(single.values()) + 0.5 * (len(single) + 1)
    close, apart = 0, []
    for i, t in enumerate(texts):
        total, before = 0.0, None
        for k, w in enumerate(tokens(t)):
            base, context = (table(single, w) + 0.5) / floor, table(single, before) if k else 0.0
            total += math.log10(0.3 * min(table(pair, (before, w)) / max(context, 1), 1) + 0.7 * base if context else base)
            before = w
        close += abs(total - one[i]) < 1e-6
        apart.append(abs(total - one[i]) / len(tokens(t)))
    # A probe is wrong in one of 128 cases, a text has some 80.
    assert close > 60 and np.mean(apart) < 0.01 and lm_score.score(docs, F.lit(True)).count() == 200


def test_language_model_likes_what_it_has_seen(spark):
    rng = random.Random(6)
    prose = [" ".join(rng.choice(["aa bb cc", "dd ee", "ff gg hh ii"]) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(prose)] + [(100, "cc bb aa hh ee ff dd ii gg " * 10)], "doc_id bigint, text string")
    got = {r.doc_id: r.score / r.n_tokens - r.base_score / r.n_tokens for r in lm_score.score(docs, F.col("doc_id") < 50).collect()}
    assert min(got[i] for i in range(50, 60)) > got[100] + 0.1


def test_language_model_without_rows(no_docs, odd_docs):
    assert lm_score.score(no_docs, F.lit(True)).collect() == []
    assert {r.n_known for r in lm_score.score(odd_docs, F.lit(False)).collect()} == {0}


def test_bloom_filter_keeps_every_level():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000).astype(np.uint64))
    level = rng.integers(1, 9, len(keys))
    held = lm_score._one(lm_score.packed_filter(keys, level))
    got = held.levels(keys, np.zeros(len(keys), np.int64))
    assert (got >= level).all() and (got > level).mean() < 0.03
    others = rng.integers(0, 1 << 48, 20_000).astype(np.uint64)
    assert (held.levels(others, np.zeros(len(others), np.int64)) > 0).mean() < 0.03


def print_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(prints))]


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows, no_docs):
    prints = [print_of(t) for _, t in odd_rows]
    groups = brute_components(prints)
    least = {g: min((i for (i, _), h in zip(odd_rows, groups) if h == g and i is not None), default=None) for g in groups}
    want = sorted((i or 0, f"{p:016x}", least[g] or 0) for (i, _), p, g in zip(odd_rows, prints, groups))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in simhash.near_duplicates(odd_docs).collect()) == want
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_links_join_what_brute_force_joins(spark, shard_rows):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "bits bigint"), 2, shard_rows)
    roots = {r.node: r.root for r in components.connected(found, "test-links").collect()}
    got, want = {}, {}
    for s, g in zip(signed, brute_components(values)):
        got.setdefault(roots.get(s, s), set()).add(s)
        want.setdefault(g, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 20)
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "u bigint, v bigint"), "test-many").collect()}
    root = {n: n for e in edges for n in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: top(n) for n in linked}
