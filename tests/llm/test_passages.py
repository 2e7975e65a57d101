"""Line dedup, decontamination and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chronopanel.llm import bpe, decontaminate, line_dedup, simhash
from chronopanel.llm.queries import ORACLES, QUERIES, quality_model

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def line(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def passages(rng):
    """Documents with shared passages of several lines or one, at any place, and short shared lines."""
    shared = [[line(rng, rng.randrange(8, 30)) for _ in range(rng.choice([1, 2, 2, 3, 5, 8]))] for _ in range(12)]
    shared = [p if len("\n".join(p)) > 400 else [line(rng, 70)] for p in shared]
    boiler, docs = [line(rng, 5) for _ in range(4)], []
    for i in range(120):
        body = [[line(rng, rng.randrange(3, 25))] for _ in range(rng.randrange(1, 12))]
        # Passages stay whole: one is never put inside another.
        for p in [*rng.sample(shared, rng.randrange(3)), [rng.choice(boiler)]]:
            body.insert(rng.randrange(len(body) + 1), p)
        docs.append((i, "\n".join(x for part in body for x in part)))
    return docs + [(200 + i, docs[i][1]) for i in range(5)], shared, boiler


def check_dedup(rows, out):
    """Every removed line stands earlier in the order of ids and lines; the others keep their order."""
    seen = set()
    for i, text in sorted(rows):
        lines, kept = text.split("\n"), [] if out[i].n_removed == len(text.split("\n")) else out[i].text.split("\n")
        assert out[i].n_lines == len(lines) and len(lines) - len(kept) == out[i].n_removed
        gone, it = Counter(lines) - Counter(kept), iter(lines)
        assert all(k in it for k in kept)
        for x, n in gone.items():
            assert x in seen or lines.count(x) > n
        seen |= set(lines)


def test_shared_passages_go_but_for_the_first(spark):
    rows, shared, boiler = passages(random.Random(11))
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    check_dedup(rows, out)
    whole = [r.text for r in out.values()]
    missed = 0
    for p in shared:
        assert sum("\n".join(p) in t for t in whole) >= 1 or not any("\n".join(p) in t for _, t in rows)
        missed += sum(t.count("\n".join(p)) for t in whole) - 1
    assert missed <= 1
    # A copied document goes whole if it is as long as a passage.
    assert all(out[200 + i].text == "" for i in range(5) if len(rows[i][1].replace("\n", "")) >= 200)
    # Short lines that repeat alone stay everywhere.
    for b in boiler:
        assert sum(b in t.split("\n") for t in whole) >= sum(b in t.split("\n") for i, t in rows if i < 200) - 3


def test_line_dedup_of_odd_rows(odd_docs, odd_rows, no_docs):
    out = line_dedup.dedup(odd_docs)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "n_removed"])
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t in odd_rows)
    assert [r.text for r in rows if r.doc_id == 1] == [None] and {r.n_removed for r in rows} == {0}
    assert line_dedup.dedup(no_docs).collect() == []


def test_rows_equal_in_id_and_text_get_equal_results(spark):
    long = "\n".join(line(random.Random(k), 40) for k in range(3))
    rows = [(2, long), (2, long), (1, "a\n" + long), (None, "b\n" + long)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 0), (1, 3), (2, 3), (2, 3)]


def shingles(text, size=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    size = min(size, len(w)) if size == 5 else size
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        for i, u in items:
            want = shingles(u)
            own = shingles(t, max([len(x.split(" ")) for x in want], default=5))
            if d is not None and want and len(own & want) >= 0.8 * len(want) - 1e-9:
                out.add((d, i, len(want), len(own & want)))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    words = [line(rng, 1) for _ in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 14, 30, 59, 120])))) for k in range(60)] + [(60, None), (61, " "), (7, "again " + line(rng, 9))]
    docs = [(None, items[8][1])]
    for k in range(200):
        body = [rng.choice(words) for _ in range(rng.randrange(400))]
        if k % 2:
            piece = WORD.findall(rng.choice(items[:60])[1])
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = piece
        docs.append((k, " ".join(x.upper() if rng.random() < 0.1 else x for x in body)))
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contained(table, bench).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 30
    # Rows are cleaned one by one: the row without an id holds an item, another text under a leaking id does not.
    bad = {d for d, *_ in want}
    extra = [(next(iter(bad)), "nothing of it")]
    both = spark.createDataFrame(docs + extra, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(both, bench).collect()) == sorted([d for d, _ in docs if d is not None and d not in bad] + [extra[0][0]])


def test_leaks_of_odd_rows(odd_docs, odd_rows, no_docs, spark):
    bench = spark.createDataFrame([(1, "quick brown fox; it's 2 o'clock."), (2, "word word"), (3, "A"), (4, None)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained(odd_docs, bench).collect())
    items = [(1, "quick brown fox; it's 2 o'clock."), (2, "word word"), (3, "A"), (4, None)]
    assert got == sorted({(d, i) for d, i, *_ in brute_leaks(odd_rows, items)})
    assert decontaminate.contained(no_docs, bench).collect() == []
    assert decontaminate.contained(odd_docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(odd_docs, bench.limit(0)).count() == len(odd_rows)


@pytest.fixture(scope="module")
def kept(spark):
    """Every stage's input and output at the smallest scale."""
    docs, steps = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        steps.append((name, docs.collect(), rows, out.columns))
        docs = spark.createDataFrame(rows, out.schema)
    return steps


def test_pipeline_stages_against_brute_force(spark, kept):
    assert [s[0] for s in kept] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(s[3] == columns for s in kept[:-1])
    (_, d0, r0, _), (_, d1, r1, _), (_, d2, r2, _), (_, d3, r3, _), (_, d4, r4, _) = kept
    model = quality_model(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = model.scores([(r.text or "").encode() for r in d0]) >= 0.3
    assert sorted(r.doc_id for r in r0) == sorted(r.doc_id for r, g in zip(d0, good) if g)
    assert sorted(r.doc_id for r in r1) == sorted(r.doc_id for r in d1)
    assert all(r.n_chars == len(r.text) for r in r1 if r.text is not None)
    from test_text_rules import brute_components, print_of

    order = sorted(d2, key=lambda r: r.doc_id)
    groups = brute_components([print_of(r.text) for r in order])
    assert sorted(r.doc_id for r in r2) == [order[g].doc_id for g in sorted(set(groups))]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in brute_leaks([(r.doc_id, r.text) for r in d3], items)}
    assert sorted(r.doc_id for r in r3) == sorted(r.doc_id for r in d3 if r.doc_id not in bad)
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in d4}
    for r in r4:
        assert list(r.ids) == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_queries_are_registered_with_their_sql():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    from tools.check_oracle import compare, connect

    exact, _, message = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert exact, message


def test_fingerprints_follow_the_builtin_hash(spark):
    """The engine's own xxhash64 has the same seed."""
    row = spark.createDataFrame([("One two  three",)], "text string").select(F.xxhash64(F.lit("one two three")).alias("h"), "text")
    bits = simhash.fingerprints(row.withColumn("doc_id", F.lit(1))).first().bits
    assert bits == row.first().h


def test_one_row_of_every_group_stays(spark):
    """Copies under repeated, clashing and missing ids: rows are judged by id and text, one of each group stays."""
    rng = random.Random(21)
    one, two, three = (line(rng, 40) for _ in range(3))
    rows = [(1, one), (1, one), (2, one), (None, one), (None, one), (1, two), (3, two), (None, three), (None, three), (4, ""), (5, None), (6, line(rng, 40))]
    table = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, bits int").repartition(3)
    got = simhash.one_of_each(table).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, one), (1, two), (0, three), (4, ""), (6, rows[-1][1])])
    assert simhash.one_of_each(table.limit(0)).collect() == []


def brute_repeats(docs, least=200):
    """Lines of every run of equal lines of `least` characters or more whose other copy stands earlier."""
    texts, gone = [(i, t.split("\n")) for i, t in sorted(docs)], set()
    for y, (i, own) in enumerate(texts):
        for x, (_, other) in enumerate(texts[: y + 1]):
            for shift in range(1 if x == y else 1 - len(other), len(own)):
                run = []
                for k in range(max(shift, 0), len(own) + 1):
                    if k < len(own) and 0 <= k - shift < len(other) and own[k] == other[k - shift]:
                        run.append(k)
                        continue
                    if sum(len(own[r]) for r in run) >= least:
                        gone |= {(i, r) for r in run}
                    run = []
    return gone


def test_many_blank_lines_inside_and_around_a_passage(spark):
    """Blank lines cost rows, not windows; they go with the passage as far as both copies have them."""
    body = "\n".join(["x" * 150, *[""] * 20_000, "y" * 60])
    rows = [(1, body), (2, body), (3, "q\n" + body + "\n\n\nz"), (4, body + "\n\n\nzz")]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_removed, r.text) for r in out} == {1: (0, body), 2: (20_002, ""), 3: (20_002, "q\n\n\nz"), 4: (20_004, "zz")}


def test_line_dedup_sql_states_the_rule(spark):
    """The probe on which chunks alone and runs differ: all lines of later copies go, in SQL too."""
    import duckdb

    rng = random.Random(23)
    docs = []
    for _ in range(12):
        a, b, c, d = (line(rng, 11) for _ in range(4))
        docs += ["\n".join([a, b]), "\n".join([c, d]), "\n".join([a, b, c, d]), "\n".join([line(rng, 4), a, b, c, d, line(rng, 5)])]
    rows = list(enumerate(docs))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({ORACLES['op2_line_dedup']})").fetchall())
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted(tuple(r) for r in got.collect()) == want and sum(r[2] for r in want) == 48


def test_line_dedup_equals_brute_force_over_all_runs(spark):
    """Also passages whose lines all stand earlier in other documents, one by one or in parts."""
    rng = random.Random(22)
    docs = []
    for _ in range(12):
        a, b, c, d = (line(rng, 11) for _ in range(4))
        docs += ["\n".join([a, b]), "\n".join([c, d]), "\n".join([a, b, c, d]), "\n".join([line(rng, 4), a, b, c, d, line(rng, 5)])]
    pool = [line(rng, rng.choice([0, 1, 2, 9, 15, 40])) for _ in range(14)] + [""]
    docs += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    gone = brute_repeats(rows)
    for i, t in rows:
        lines = t.split("\n")
        assert out[i].text == "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        assert out[i].n_removed == sum((i, k) in gone for k in range(len(lines)))
    assert len(gone) > 100
