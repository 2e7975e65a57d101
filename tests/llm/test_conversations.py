"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import types as T

from chronopanel.llm import conversation

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, digest int, copied string, present string"
PATTERN = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each of the sorted (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, audit, repaired) by uniform cost over every edit and any number of inserted messages."""
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, k, roles, made = heapq.heappop(queue)
        if k == len(rows) and PATTERN.fullmatch(roles):
            return cost, audit, made
        # Only beginnings of legal sequences are followed.
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        for r, name in (("u", "user"), ("a", "assistant")):
            if len(roles) < 2 * len(rows) + 3:
                heapq.heappush(queue, (cost + 3, audit + "I", k, roles + r, made + ((name, ""),)))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(queue, (cost + 4, audit + "D", k + 1, roles, made))
            if bad[k] not in ("blank", "duplicate"):
                stay = cost + 3 * (bad[k] == "truncated")
                if role:
                    heapq.heappush(queue, (stay, audit + "K", k + 1, roles + role[0], made + ((role, text),)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(queue, (stay + 3, audit + "R", k + 1, roles + r, made + ((name, text),)))


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    bad = faults(rows)
    cost, audit, made = cheapest(rows, bad)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(bad.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def chats():
    rng, out = random.Random(5), {}
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", "Fine. \t", "a.b", "日本。", "x?"]
    for k in range(400):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user"], ["assistant"], ["user", "tool", None, "", "usurper", "system"]])
        out[k] = [(rng.choice([None, 0, 1, 2, 3, 4, 7]) if rng.random() < 0.4 else t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, 7))]
    return out


def frame(spark, chats):
    rows = [(c, *r, "c", 1, "x", "p") for c, rows in chats.items() for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, T._parse_datatype_string(SCHEMA)).repartition(4)


def test_repair_equals_a_search_over_all_edits(spark):
    cases = chats()
    cases[None] = [(0, "user", "Hello."), (1, "user", "Hello."), (2, "assistant", "Hi.")]
    got = {r.conv: tuple(r)[1:] for r in conversation.report(frame(spark, cases)).collect()}
    assert got == {c: expected(rows) for c, rows in cases.items()}


def test_edits_rebuild_the_report(spark):
    cases = chats()
    table = frame(spark, cases)
    want = {r.conv: (r.audit, r.repaired_sha256) for r in conversation.report(table).collect()}
    steps = {}
    for r in conversation.edits(table).collect():
        steps.setdefault(r.conv, []).append(r)
    for c, rows in steps.items():
        rows.sort(key=lambda r: r.step)
        assert [r.step for r in rows] == list(range(len(rows)))
        kept = [f"{r.role}:{r.text}" for r in rows if r.edit != "D"]
        assert ("".join(r.edit for r in rows), hashlib.sha256("\n".join(kept).encode()).hexdigest()) == want[c]
        assert sum(r.edit != "I" for r in rows) == len(cases[c])
    assert steps.keys() == cases.keys()


def plain(rows):
    """(cost, audit) with whole strings for survivors, none dropped early."""
    kept, after = conversation._KEPT, conversation._NEXT
    alive = {0: (0, "")}
    for initial, must, cut in rows:
        new = {}
        for state, (cost, audit) in alive.items():
            options = [(state, cost + 4, audit + "D")]
            for pre, at in (("", state), ("I", after[state])) if not must else ():
                paid = cost + 3 * cut + 3 * len(pre)
                options.append((after[at], paid + 3, audit + pre + "R"))
                if (at, initial) in kept:
                    options.append((kept[at, initial], paid, audit + pre + "K"))
            for to, *option in options:
                new[to] = min(new.get(to, (1 << 60, "")), tuple(option))
        alive = new
    return min((c + 3 * len(e), a + e) for s, (c, a) in alive.items() for e in [{0: "", 1: "II", 2: "I", 3: ""}[s]])


@pytest.mark.parametrize("weights", [(0, 1, 1), (1, 5, 5), (0, 1, 0), (1, 0, 0), (1, 1, 0)])
def test_long_conversations_and_what_stays_in_memory(weights):
    rng = random.Random(sum(weights))
    rows = [(rng.choices("sua", weights)[0], rng.random() < 0.05, rng.random() < 0.2) for _ in range(3000)]
    one, audit, most = conversation.Repair(), "", 0
    for k, row in enumerate(rows):
        audit += "".join(n.edit for n in one.step(*row, k))
        most = max(most, one.nodes)
        alive, todo = set(), [n for _, n, _ in one.survivors.values()]
        if k % 500 == 0:
            # Exactly the nodes that a survivor reaches are held.
            while todo:
                if (n := todo.pop()) is not one.root and id(n) not in alive:
                    alive.add(id(n))
                    todo.append(n.parent)
            assert len(alive) == one.nodes
    cost, rest = one.finish()
    assert (cost, audit + "".join(n.edit for n in rest)) == plain(rows)
    if weights == (1, 5, 5):
        assert most < 300


def test_a_conversation_of_one_role_stays_exact():
    rows = [("u", False, False)] * 2001
    one = conversation.Repair()
    done = [n.edit for row in rows for n in one.step(*row, None)]
    cost, rest = one.finish()
    assert (cost, "".join(done + [n.edit for n in rest])) == plain(rows)


def test_damage_and_empty_conversations(spark):
    import zlib

    rows = [(c, t, random.Random(c * 100 + t).choice(["user", "assistant", None]), random.Random(c + t).choice(["One. Two?", None, "Three"])) for c in range(60) for t in range(4)]
    rows += [(None, None, "user", "Hi."), (1000, None, None, None)]
    table = spark.createDataFrame([(*r, "c", 1, "x", "p") for r in rows], SCHEMA)
    from pyspark.sql import functions as F

    got = {r.conv: tuple(r)[1:] for r in conversation.report(conversation.damaged(table), present=F.col("present")).collect()}
    left = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        left[c] += [(t, "user" if how == 4 else r, x)] * (0 if how == 0 else 2 if how == 3 else 1)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected(x) if x else empty for c, x in left.items()}
    assert conversation.report(table.limit(0)).collect() == [] and conversation.edits(table.limit(0)).collect() == []
