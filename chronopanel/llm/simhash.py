"""SimHash near-duplicates: BK-trees over fingerprints.

1. Every text gets a 64-bit fingerprint from its word shingles (row by row).
2. Distinct fingerprints are dealt to shards.  Of radius + 2 equal blocks of bits,
   two fingerprints within the radius agree on at least two, so a shard is a pair
   of blocks and their value: every link lies inside some shard.
3. Each shard builds a BK-tree, children keyed by their Hamming distance to the
   parent, and asks it for every fingerprint, following only edges within the
   radius.  A shard gives back a spanning forest of its links, not the pairs.
4. Components of the forest edges, and back to the documents.

The trees are not broadcast: together they hold the fingerprints of all
documents, which no driver may collect.  Each tree lives in the task that asks it.
A shard above `SHARD_ROWS` is dealt again by a third of its free bits, up to three
times, so a shard never exceeds 2**15 fingerprints at radius 2.

Defined results: null and empty texts have fingerprint zero and link like any
other; exact copies share a fingerprint; repeated rows stay; a null id takes its
component's smallest id, null if there is none; other columns are not read.
`one_of_each` keeps one row of every component, whatever its ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm import spans
from chronopanel.llm.components import connected, forest
from chronopanel.llm.shared import broadcast_within, freed, stored

BITS = 64
#: Shards with more fingerprints are dealt again.
SHARD_ROWS = 4096
REDEALS = 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_values(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of a chunk's texts, and the n + 1 positions between texts."""
    raw, offsets = spans.text_buffer(texts)
    raw = spans.lowered(raw)
    starts, ends, first = spans.word_spans(raw, offsets)
    lengths = ends - starts
    # All words with one space between them: a shingle is one slice.
    stop = np.cumsum(lengths + 1) - 1
    begin = stop - lengths
    joined = np.full(int(stop[-1]) + 1 if len(stop) else 0, 32, np.uint8)
    joined[spans.flat_positions(begin, lengths)] = raw[spans.flat_positions(starts, lengths)]
    words = np.diff(first)
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    lead = spans.flat_positions(first[:-1], count)
    tail = np.minimum(lead + shingle - 1, np.repeat(first[1:], count) - 1)
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(begin[lead].tolist(), stop[tail].tolist())), "<u8", len(lead))
    return hashes, np.concatenate([[0], np.cumsum(count)])


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes, as unsigned numbers."""
    out = np.zeros((len(bounds) - 1, 8), np.uint8)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            ones = np.unpackbits(octets[a:b], axis=1).sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > b - a)
    return out.view("<u8").reshape(-1)


def fingerprint_values(texts: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """The fingerprint of every text of a chunk, as unsigned numbers."""
    return majority_bits(*shingle_values(texts, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, *more: str) -> DataFrame:
    """(doc_id, bits): the fingerprint of every text as a signed 64-bit number; the columns `more` are carried along.

    Words of `[^\\x20\\x09-\\x0D]+` in lower-cased A-Z; a bit is 1 if it is set in over half of the shingles' XXH64.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c] for c in more])
    kinds = dict(rows.dtypes)
    names = ["doc_id", "bits", *more]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                bits = fingerprint_values(part.column(1), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view("<i8")), *part.columns[2:]], names)

    return rows.mapInArrow(run, ", ".join(["doc_id " + kinds["doc_id"], "bits bigint", *[f"`{c}` {kinds[c]}" for c in more]]))


class BKTree:
    """Distinct fingerprints; a child's key is its distance to the parent."""

    def __init__(self, root: int):
        self.values, self.children = [root], [{}]

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """Numbers of the stored values within the radius; the value is stored afterwards."""
        values, children, found, todo = self.values, self.children, [], [0]
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            kids = children[node]
            if kids:
                for key in range(d - radius, d + radius + 1):
                    if key in kids:
                        todo.append(kids[key])
        node = 0
        while True:
            d = (values[node] ^ value).bit_count()
            after = children[node].get(d)
            if after is None:
                children[node][d] = len(values)
                values.append(value)
                children.append({})
                return found
            node = after


def tree_links(values: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Links of distinct fingerprints, as positions; links whose ends are joined already are left out."""
    tree, left, right = BKTree(values[0]), [], []
    root = list(range(len(values)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(1, len(values)):
        for other in tree.near_then_add(values[k], radius):
            a, b = top(k), top(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(k)
                right.append(other)
    return left, right


def shard_masks(radius: int) -> list[int]:
    """Bit masks of two of radius + 2 blocks."""
    size = BITS // (radius + 2) + (BITS % (radius + 2) > 0)
    blocks = [sum(1 << b for b in range(lo, min(lo + size, BITS))) for lo in range(0, BITS, size)]
    return [a | b for a, b in combinations(blocks, 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 parts of its free bits: within the radius, one part agrees."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: radius + 1]) for k in range(radius + 1)]


def links(distinct: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v): a spanning forest per shard of the links between the fingerprints in column bits."""

    def column(masks: list[int]):
        return F.array(*[F.lit(_signed(m)) for m in masks])

    masks = shard_masks(radius)
    rows = distinct.select("bits", F.explode(column(masks)).alias("mask")).withColumn("value", F.col("bits").bitwiseAND(F.col("mask")))
    ready = None
    for _ in range(REDEALS):
        sizes = rows.groupBy("mask", "value").count()
        large = stored(sizes.where(F.col("count") > shard_rows).select("mask", "value"), "simhash-large")
        if large.isEmpty():
            break
        cold = rows.join(large, ["mask", "value"], "left_anti").select("bits", "mask", "value")
        ready = cold if ready is None else ready.union(cold)
        finer = {m: finer_masks(m, radius) for m in masks}
        table = F.create_map(*[x for m, ms in finer.items() for x in (F.lit(_signed(m)), column(ms))])
        again = rows.join(large, ["mask", "value"], "left_semi").select("bits", F.explode(table[F.col("mask")]).alias("mask"))
        rows = stored(again.withColumn("value", F.col("bits").bitwiseAND(F.col("mask"))).select("bits", "mask", "value"), "simhash-shards")
        masks = [m for ms in finer.values() for m in ms]
    rows = rows.select("bits", "mask", "value")
    ready = rows if ready is None else ready.union(rows)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.repartition(parts, "mask", "value").sortWithinPartitions("mask", "value", "bits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(3)]
            mask, value, bits = (np.concatenate([r, n]) for r, n in zip(rest, now)) if rest else now
            if not len(bits):
                continue
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            last = int(edge[-1]) if len(edge) else 0
            # The last shard may go on in the next batch.
            rest = [mask[last:], value[last:], bits[last:]]
            yield shards(bits[:last], edge[:-1])
        if rest:
            yield shards(rest[2], np.zeros(0, np.int64))

    def shards(bits: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        bounds = np.concatenate([[0], edge, [len(bits)]]).astype(np.int64)
        left, right = [], []
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            lo, hi = bounds[k], bounds[k + 1]
            a, b = tree_links(bits[lo:hi].view(np.uint64).tolist(), radius)
            left += (lo + x for x in a)
            right += (lo + x for x in b)
        u, v = bits[np.array(left, np.int64)], bits[np.array(right, np.int64)]
        u, v = forest(u, v) if len(u) else (u, v)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.select("mask", "value", "bits").mapInArrow(run, "u bigint, v bigint")


def _named(prints: DataFrame, radius: int) -> DataFrame:
    """(bits, node, component_id) of every distinct fingerprint: a fingerprint that stands for its component, and the component's smallest id."""
    classes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-classes")
    nodes = connected(links(classes, radius), "simhash-links")
    nodes = stored(nodes.join(classes.withColumnRenamed("bits", "node"), "node"), "simhash-nodes")
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    smallest = stored(smallest, "simhash-roots")
    linked = nodes.join(smallest, "root").select(F.col("node").alias("bits"), F.col("root").alias("linked"), "component_id")
    out = classes.join(linked, "bits", "left").select("bits", F.coalesce("linked", "bits").alias("node"), F.coalesce("component_id", "first").alias("component_id"))
    out = stored(out, "simhash-named")
    freed(classes, nodes, smallest)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-prints")
    named = _named(prints, radius).drop("node")
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row of every component, with all its columns: the one of the smallest id, null ids last.

    Rows are told apart by id and text, so another text under the same id is judged
    for itself.  Only rows equal in both are compared in their other columns, to
    keep one of them.
    """
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    prints = stored(fingerprints(docs.withColumn("__h", own), id_col, text_col, shingle, seed, "__h"), "simhash-prints")
    named = _named(prints, radius)
    each = prints.join(named.select("bits", "node"), "bits")
    best = each.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h")).alias("k"))
    best = stored(best.select(F.col("k.doc_id").alias("__id"), F.col("k.__h").alias("__kept")), "simhash-best")
    rows = prints.groupBy("doc_id", "__h").count()
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kept")), "left")
    kept = stored(kept.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__text"), F.col("__kept").isNotNull().alias("__stays"), "count"), "simhash-kept")
    freed(prints, named, best)
    same = docs[id_col].eqNullSafe(F.col("__id")) & (own == F.col("__text"))
    gone = broadcast_within(kept.where("NOT __stays").select("__id", "__text"))
    rest = docs.join(gone, same, "left_anti")
    again = kept.where("__stays AND count > 1").select("__id", "__text")
    if again.isEmpty():
        return rest
    again = broadcast_within(again)
    # Repeated rows of a kept text: one of them, chosen by all columns.
    numbered = docs.join(again, same, "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy(id_col, own).orderBy(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])))
    return rest.join(again, same, "left_anti").union(numbered.where("__n = 1").drop("__n"))
