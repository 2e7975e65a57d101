"""Conversation structure repair: cheapest edits to turns of user and assistant, by Viterbi with coalescing survivors.

Rows of a conversation stand in the order of their turn.  A row may be kept,
deleted, or given the role that fits, and empty messages may be inserted, so that
the roles read system (or none), user, assistant, user, assistant, …  The states of
the search are what stood last: nothing, system, user, assistant.  For every state
the cheapest edits up to a row survive, of equally cheap ones the least in ASCII.

Survivors are leaves of one tree of edits with pointers back and reference counts.
An edit leaves the tree with its last survivor; as soon as all survivors share an
ancestor the edits up to it are final, are handed out and freed.  So a conversation
streams through its task, and what is held is the part that is still open.  Survivors
that another one beats whatever follows are dropped, which closes that part early.
Equally cheap survivors are compared over their whole open suffixes: none is the
beginning of another, as each ends with the edit of the same row, so their order is
settled where they part and kept as a rank from row to row.

A conversation that can never be closed early (users only, to the end) holds one
small node a row and survivor.  Its edits depend on one another to the last row, so
a conversation is the unit of work; its rows are sorted by Spark, which spills.
Earlier copies of a message are found by one aggregation over digests before the
shuffle, not by a set in the task.

Defined results: rows are ordered by turn, nulls first, then role and text; null
roles and texts count as one space; a null id is a conversation of its own; a role
whose first letter is not s, u or a is never kept, nor is an empty one; repeated
rows are duplicates; other columns are not read; no rows give no conversations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import broadcast_within, stored

#: What stood last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Fixed costs of the edits, and of a truncated row that stays.
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after one more message of the role that fits.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The state after a kept message, by first letter.
_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}
#: (state, other state, extra): the other state reaches all that the state does for `extra` more, by inserting.
_COVERED = [(USER, ASSISTANT, 3), (ASSISTANT, USER, 3), (SYSTEM, ASSISTANT, 0), (SYSTEM, USER, 3), (SYSTEM, NOTHING, 0)]
_BLANK, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


class Node:
    """One edit; `refs` counts its children and the survivor that ends with it."""

    __slots__ = ("edit", "role", "row", "parent", "refs")

    def __init__(self, edit: str, role: str, row, parent: Node | None):
        self.edit, self.role, self.row, self.parent, self.refs = edit, role, row, parent, 0
        if parent is not None:
            parent.refs += 1


class Repair:
    """Survivors of one conversation; `step` takes its rows in order, `finish` closes it; both hand out final edits."""

    def __init__(self):
        self.root = Node("", "", None, None)
        self.root.refs = 1
        #: state: (cost, last edit, rank of the whole open suffix)
        self.survivors = {NOTHING: (0, self.root, 0)}
        self.nodes, self.check = 0, 64

    def step(self, initial: str, must_go: bool, truncated: bool, row) -> list[Node]:
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, rank: int, edits: str, parent: Node, role: int | None):
            new = (cost, rank, edits, parent, role)
            if state not in best or new[:3] < best[state][:3]:
                best[state] = new

        for state, (cost, node, rank) in self.survivors.items():
            offer(state, cost + COST[DELETE], rank, DELETE, node, None)
            if must_go:
                continue
            stay = cost + TRUNCATED_COST * truncated
            # A second message before the same row would lead back; after a deletion it would only be larger in ASCII.
            for before, at in (("", state), (INSERT, _NEXT[state])):
                paid = stay + COST[INSERT] * len(before)
                if (at, initial) in _KEPT:
                    offer(_KEPT[at, initial], paid, rank, before + KEEP, node, None)
                offer(_NEXT[at], paid + COST[REROLE], rank, before + REROLE, node, _NEXT[at])
        self._prune(best)
        old = [node for _, node, _ in self.survivors.values()]
        self.survivors = {}
        for rank, state in enumerate(sorted(best, key=lambda s: best[s][1:3])):
            cost, _, edits, node, role = best[state]
            if edits[0] == INSERT:
                # The inserted message stands before the row's own, which is never a kept system message.
                node = self._grown(node, INSERT, _ROLE[ASSISTANT if state == USER else USER], None)
            last = self._grown(node, edits[-1], _ROLE.get(role, ""), row)
            last.refs += 1
            self.survivors[state] = (cost, last, rank)
        for node in old:
            self._release(node)
        return self._settled() if self.nodes >= self.check else []

    def _grown(self, parent: Node, edit: str, role: str, row) -> Node:
        self.nodes += 1
        return Node(edit, role, row, parent)

    def _prune(self, best: dict[int, tuple]) -> None:
        """Drop states that another one beats whatever follows."""
        for state, other, extra in _COVERED:
            if state in best and other in best:
                (cost, *mine), (least, *its) = best[state][:3], best[other][:3]
                if cost > least + extra or cost == least + extra and its < mine:
                    del best[state]
        # Only a system message may follow nothing and not an assistant: it can be deleted.
        for other, extra in ((ASSISTANT, 0), (USER, COST[INSERT])):
            if NOTHING in best and other in best and best[NOTHING][0] > best[other][0] + extra + COST[DELETE]:
                del best[NOTHING]

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            self.nodes -= 1
            node = node.parent

    def _path(self, node: Node) -> list[Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _settled(self) -> list[Node]:
        """Edits that all survivors share; the tree begins after them from now on."""
        path, done = self._path(next(iter(self.survivors.values()))[1]), []
        for node in path:
            if self.root.refs > 1:
                break
            done.append(node)
            self.root = node
        # The new root holds no edit; its own row is handed out.
        self.root.parent = None
        self.nodes -= len(done)
        self.check = 2 * self.nodes + 64
        return done

    def finish(self) -> tuple[int, list[Node]]:
        """Cost of the cheapest edits, and those not handed out yet."""
        ends = {NOTHING: "", ASSISTANT: "", USER: INSERT, SYSTEM: INSERT + INSERT}
        options = [(cost + COST[INSERT] * len(ends[state]), rank, state, node) for state, (cost, node, rank) in self.survivors.items()]
        cost, _, state, node = min(options, key=lambda x: x[:2])
        tail = [_ROLE[_NEXT[state]], _ROLE[ASSISTANT]][: len(ends[state])]
        return cost, self._path(node) + [Node(INSERT, role, None, None) for role in tail]


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, present, blank, truncated, first_turn, copied), sorted within partitions that hold whole conversations.

    Rows whose `present` is false only announce their conversation.  `copied` tells
    that role and text stand in several rows, the earliest at `first_turn`.
    """
    space = F.lit(" ")
    own = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    own = own.withColumn("digest", F.unhex(F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")), 256)))
    groups = own.where("present").groupBy("conv", "digest").agg(F.count(F.lit(1)).alias("n"), F.count("turn").alias("numbered"), F.min("turn").alias("least"))
    # Nulls come first.
    first = F.when(F.col("n") == F.col("numbered"), F.col("least"))
    copies = stored(groups.where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), first.alias("first_turn"), F.lit(True).alias("copied")), "conversation-copies")
    found = own.join(broadcast_within(copies), F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & F.col("present"), "left")
    found = found.select(
        "conv", "turn", "role", "text", "present", (~F.col("text").rlike(_INK)).alias("blank"), (~F.col("text").rlike(r"[.!?]" + _BLANK + r"*\z")).alias("truncated"),
        "first_turn", F.coalesce("copied", F.lit(False)).alias("copied"),
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")


class Conversation:
    """Counts and open edits of the conversation that streams by."""

    def __init__(self, conv):
        self.conv, self.repair = conv, Repair()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = self.steps = 0
        self.low = self.high = self.before = None

    def take(self, turn, role: str, text: str, blank: bool, truncated: bool, first_turn, copied: bool) -> list[Node]:
        """Final edits so far, after one more row."""
        initial, same = role[:1], self.before is not None and self.before[:3] == (turn, role, text)
        duplicate = copied and (turn != first_turn or same)
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else ""
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before[1][:1] + initial not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            self.distinct += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.before = (turn, role, text)
        return self.repair.step(initial, fault in ("blank", "duplicate"), fault == "truncated", (turn, role, text, fault))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Conversation, list[Node], int | None]]:
    """(conversation, further final edits, its cost once it ends) over sorted rows."""
    now: Conversation | None = None
    for batch in batches:
        for conv, turn, role, text, present, *rest in zip(*(batch.column(k).to_pylist() for k in range(9))):
            if now is None or conv != now.conv:
                if now is not None:
                    cost, edits = now.repair.finish()
                    yield now, edits, cost
                now = Conversation(conv)
            if present and (edits := now.take(turn, role, text, *rest)):
                yield now, edits, None
    if now is not None:
        cost, edits = now.repair.finish()
        yield now, edits, cost


def _message(node: Node) -> tuple[str, str] | None:
    """(role, text) of an edit's message; None if it goes."""
    if node.edit == DELETE:
        return None
    return (node.role, "") if node.edit == INSERT else (node.role or node.row[1], node.row[2])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of some rows or some bytes of text, whichever comes first."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def edits(rows: DataFrame, **columns) -> DataFrame:
    """(conv, step, edit, turn, role, text, fault): every edit in order; a deleted row shows what went, an inserted one has no turn."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sorted_rows = ordered(rows, **columns)
    kinds = dict(sorted_rows.dtypes)
    out = sorted_rows.select("conv", F.lit(0).cast("long").alias("step"), F.lit("").alias("edit"), "turn", "role", "text", F.lit("").alias("fault")).schema
    schema = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for now, done, _ in _streamed(batches):
                for node in done:
                    turn, role, text, fault = node.row or (None, "", "", "")
                    if message := _message(node):
                        role, text = message
                    yield now.conv, now.steps, node.edit, turn, role, text, fault
                    now.steps += 1

        yield from _batches(each(), schema)

    return sorted_rows.mapInArrow(run, f"conv {kinds['conv']}, step bigint, edit string, turn {kinds['turn']}, role string, text string, fault string")


def report(rows: DataFrame, **columns) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    audit: initials of the edits; repaired_sha256: of the repaired `role:text`, joined by newlines.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    sorted_rows = ordered(rows, **columns)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = sorted_rows.select("conv", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"), F.lit("").alias("repaired_sha256")).schema
    schema = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            audit, digest, written = bytearray(), sha256(), False
            for now, done, cost in _streamed(batches):
                for node in done:
                    audit += node.edit.encode()
                    if message := _message(node):
                        digest.update(("\n" * written + ":".join(message)).encode())
                        written = True
                if cost is not None:
                    yield now.conv, now.gaps, *now.faults.values(), now.illegal, cost, audit.decode(), digest.hexdigest()
                    audit, digest, written = bytearray(), sha256(), False

        yield from _batches(each(), schema)

    return sorted_rows.mapInArrow(run, ", ".join([f"conv {dict(sorted_rows.dtypes)['conv']}", *[f"{c} bigint" for c in counts], "audit string", "repaired_sha256 string"]))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by the remainder of crc32(`conv_id:turn`) by 20.

    0 drops the row (present is false), 1 empties its text, 2 removes `[.!?]`, 3
    repeats it, 4 sets the role to user; nulls count as one space.
    """
    space = F.lit(" ")
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), space) if c else F.lit(":") for c in (conv_col, None, turn_col)])
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("how"))
    how = F.col("how")
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = own.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (how != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(how == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")
