"""Classifiers: held-out accuracy on small made-up texts, and defined results."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import langid, quality, toxicity
from chronopanel.llm.sampling import labelled_sample


def prose(rng, syllables, n=60):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


TONGUES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "zu"], "cc": ["eau", "oi", "que", "é"], "dd": ["ñ", "ción", "os", "ll"], "ee": ["th", "ing", "ed", "or"]}


def test_languages_held_out():
    rng = random.Random(1)
    rows = [(prose(rng, s), k) for k, s in TONGUES.items() for _ in range(40)]
    rng.shuffle(rows)
    model = langid.fit(rows[:120])
    names, score, _ = model.predict(pa.array([t for t, _ in rows[120:]]), 0.05)
    assert np.mean([a == b for a, (_, b) in zip(names, rows[120:])]) == 1
    assert ((score >= 0) & (score <= 1)).all()


@pytest.mark.parametrize("kinds", [2, 3, 4, 6, 9, 20])
def test_codewords_are_apart(kinds):
    code = langid.codewords(kinds)
    apart = [int((code[a] != code[b]).sum()) for a in range(kinds) for b in range(a)]
    assert min(apart) >= (1 if kinds == 2 else 2)
    assert all(0 < (column == 1).sum() < kinds for column in code.T)


def test_language_of_odd_rows(odd_docs, no_docs):
    rng = random.Random(2)
    model = langid.fit([(prose(rng, s), k) for k, s in TONGUES.items() for _ in range(20)])
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd_docs, model).collect()}
    assert {got[i] for i in (1, 2, 3)} == {"und"} and got[7] in TONGUES and got[None] in TONGUES
    assert langid.identify(no_docs, model).collect() == []
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit([])).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit([("a", "aa")])).collect()} == {"und", "aa"}


def test_language_sample_is_bounded_and_leaves_the_fold(spark):
    rows = [(i, f"text {i}", "aa" if i % 3 else None) for i in range(60)]
    sample = langid.labelled_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.col("doc_id") % 2 == 0, 5, 100)
    assert len(sample) == 5 and all(int(t.split()[1]) % 2 == 0 and k == "aa" for t, k in sample)


INSULTS = ["blorgun", "zwackel", "frumpox"]


def toxic_rows(rng, n):
    rows = []
    for k in range(n):
        words = prose(rng, TONGUES["ee"], rng.randrange(30, 400)).split(" ")
        if k % 2:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "s", "!", "."]))
        rows.append((" ".join(words), k % 2))
    return rows


def test_toxicity_held_out_and_misspelled():
    rng = random.Random(3)
    model = toxicity.fit(toxic_rows(rng, 300))
    test = toxic_rows(rng, 200)
    p = model.scores(pa.array([t for t, _ in test]))
    assert np.mean((p >= 0.5) == np.array([v for _, v in test])) > 0.98
    clean = prose(rng, TONGUES["ee"], 100)
    plain, spelled = model.scores(pa.array([clean, clean + " blorgunn zwwackel frumpoxx"]))
    assert spelled > plain + 0.2
    # A long text with one toxic passage in it, and nothing at all.
    assert model.scores(pa.array([prose(rng, TONGUES["ee"], 3000) + " blorgun zwackel " + prose(rng, TONGUES["ee"], 3000), None])).round().tolist() == [1, 0]


def test_toxicity_equals_brute_force_over_all_windows():
    rng = random.Random(9)
    model = toxicity.fit(toxic_rows(rng, 200))
    texts = [t for t, _ in toxic_rows(rng, 40)] + ["one", "a a a b a", "", prose(rng, ["ka", "to"], 400)]

    def value(word):
        bags, bounds, code, _ = toxicity._chunk_words(pa.array([word]))
        return float(model.table[bags].astype(float).mean())

    def brute(text):
        words = text.lower().split()
        starts = range(max(1, len(words) - toxicity.WINDOW + 1)) if words else []
        sums = [sum(value(w) for w in set(words[s : s + toxicity.WINDOW])) / toxicity.WINDOW for s in starts]
        return 1 / (1 + np.exp(-(max(sums, default=0.0) + model.constant)))

    assert model.scores(pa.array(texts)) == pytest.approx([brute(t) for t in texts], abs=1e-6)


def test_toxicity_does_not_depend_on_the_place():
    rng = random.Random(10)
    model = toxicity.fit(toxic_rows(rng, 200))
    passage = "blorgun " + prose(rng, TONGUES["ee"], 4) + " zwackel " + prose(rng, TONGUES["ee"], 3)
    before, after = prose(rng, TONGUES["ee"], 24).split(" "), prose(rng, TONGUES["ee"], 24)
    p = model.scores(pa.array([" ".join([*before[k:], passage, after]) for k in range(13)]))
    assert p.min() > 0.5 and np.ptp(p) < 1e-9


def test_toxicity_of_odd_rows(odd_docs, no_docs):
    model = toxicity.fit(toxic_rows(random.Random(4), 60))
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score(no_docs, model).collect() == []
    for sample in ([], [("a b", 1)], [("a", 0), ("b", 0)], [("", 1), ("", 0)]):
        assert {r.predicted for r in toxicity.score(odd_docs, toxicity.fit(sample)).collect()} == {0}


def junk(rng):
    return " ".join(w + rng.choice(["$$$", "***", "###"]) for w in prose(rng, TONGUES["ee"], 80).split(" "))


def test_quality_held_out():
    rng = random.Random(5)
    rows = [(junk(rng), 0) if k % 2 else (prose(rng, TONGUES["ee"], 80), 1) for k in range(300)]
    model = quality.fit(rows[:200])
    p = model.scores([t.encode() for t, _ in rows[200:]])
    assert np.mean((p >= 0.3) == np.array([v for _, v in rows[200:]])) > 0.97


def test_quality_of_odd_rows(odd_docs, no_docs):
    rng = random.Random(6)
    model = quality.fit([(junk(rng), 0) if k % 2 else (prose(rng, TONGUES["ee"], 80), 1) for k in range(120)])
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = quality.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.score(no_docs, model).collect() == [] and quality.accepted(no_docs, model).collect() == []
    assert {r.score for r in quality.score(odd_docs, quality.fit([])).collect()} == {0.5}


def test_sample_of_labelled_rows(spark):
    docs = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(50)] + [(None, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(50)], "doc_id bigint, quality int")
    sample = labelled_sample(docs, labels, "quality", F.col("doc_id") < 40, 4, 30)
    assert sorted(v for _, v in sample) == [0] * 4 + [1] * 4 and all(len(t) <= 30 and (len(t) % 2 == v or not t) for t, v in sample)
    assert sample == labelled_sample(docs.repartition(3), labels, "quality", F.col("doc_id") < 40, 4, 30)


def test_quality_sample_takes_texts_of_up_to_65536_bytes(spark, monkeypatch):
    from chronopanel.llm import queries

    monkeypatch.setattr(queries.quality, "fit", lambda sample: sample)
    docs = spark.createDataFrame([(i, chr(97 + i) * (65_536 + i // 10)) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    sample = queries.quality_model(docs, labels)
    assert sample and {len(t) for t, _ in sample} == {65_536}
