"""Token ids in raw binary shards, addressed by document key through a minimal perfect hash.

Layout below one folder:

- `ids/*.bin`: a 16-byte header (magic, version, id width, 0), then the ids of the
  shard's documents, little-endian unsigned, in ascending key order, each document
  closed by the end id; an id takes 2 bytes where the vocabulary allows, else 4;
- `manifest`: Parquet, (key, shard, file, at, n) of each document, at counted in ids;
- `shards`: Parquet, one row per shard with its file, first global id position and size;
- `index`: Parquet, one row per hash bucket with the bytes of its hash function,
  slots and entries.

A lookup takes the bucket from the key's hash, the slot from the bucket's
hash-and-displace function, compares the stored fingerprint and follows the slot
to shard and position: constant time per key, and no index larger than a bucket
in memory.  Buckets are sized by the number of keys, so they stay as small on
any input.  Shard files carry the task attempt in their name and only the
manifest's committed rows name files, so a repeated task leaves an unread file
and nothing else.

Defined results: null text holds the end id alone; a null key is a key like any
other; repeated keys keep all their documents, in the order of their text; keys
that were never stored give no row.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.llm import spans
from chronopanel.llm.bpe import one_word, piece_spans
from chronopanel.llm.shared import file_system

MAGIC = b"TIDS"
HEADER_BYTES = 16
#: Keys of an index bucket on average; sets the number of buckets from the number of keys.
BUCKET_KEYS = 4_096
#: Distinct pieces remembered between chunks; beyond it the cache starts anew.
CACHE_ENTRIES = 600_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class LibraryEncoder:
    """Encodes chunks with the tokenizers library, each distinct piece once.

    Pieces are cut where neither the normaliser nor the splitting pattern can
    reach across.  Pieces of letters alone are one word for the library, so all
    new ones go through it as one text; the rest go one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode()
        self.guard = np.zeros(256, bool)
        self.guard[list(set(added))] = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Known pieces by number, and their ids end to end."""
        self.known: dict[bytes, int] = {}
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, simple: list[bytes], odd: list[bytes]) -> None:
        ids, sizes = [self.ids], [np.diff(self.bounds)]
        if simple:
            text = " ".join(p.decode() for p in simple)
            flat = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[flat]) + 1
            if len(ends) != len(simple):  # a vocabulary without word ends
                enc = self.tokenizer.encode(text, add_special_tokens=False)
                flat, ends = np.array(enc.ids, np.uint32), np.searchsorted(np.array(enc.word_ids, np.int64), np.arange(1, len(simple) + 1))
            ids.append(flat)
            sizes.append(np.diff(ends, prepend=0))
        for enc in self.tokenizer.encode_batch_fast([p.decode() for p in odd], add_special_tokens=False):
            ids.append(np.array(enc.ids, np.uint32))
            sizes.append(np.array([len(enc.ids)]))
        for p in (*simple, *odd):
            self.known[p] = len(self.known)
        self.ids, self.bounds = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each closed by the end id, and the n + 1 bounds between texts."""
        starts, ends, _ = piece_spans(raw, offsets, self.guard)
        starts = starts + ((raw[starts] == 32) | (raw[starts] == 10)) if len(starts) else starts
        starts, ends = starts[starts < ends], ends[starts < ends]
        first = np.searchsorted(starts, offsets)
        ids, totals = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(starts):
            simple = one_word(raw, starts, ends)
            low = spans.lowered(raw)
            # Added tokens are matched before lower-casing, so other pieces keep their case.
            kept = spans.flat_positions(starts[~simple], (ends - starts)[~simple])
            low[kept] = raw[kept]
            model, code = spans.distinct_spans(low, starts, ends)
            pieces = spans.span_texts(low, starts[model], ends[model])
            if len(self.known) > CACHE_ENTRIES:
                self._forget()
            new = [(p, s) for p, s in zip(pieces, simple[model].tolist()) if p not in self.known]
            if new:
                self._learn([p for p, s in new if s], [p for p, s in new if not s])
            number = np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))
            ids, lengths = spans.gathered(self.ids, self.bounds, number[code])
            totals = np.concatenate([[0], np.cumsum(lengths)])
        bounds = totals[first]
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    """One encoder for each Python worker, with the pieces it knows."""
    return LibraryEncoder(path)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, end_id: int = 2) -> str:
    """Encode every text, write shards in ascending key order and their index below `path`; returns `path`."""
    spark, vocab = docs.sparkSession, vocab_path or default_vocabulary()
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    kind, folder = dict(rows.dtypes)["key"], os.path.join(path, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, at, out, width = None, TaskContext.get().partitionId(), 0, None, 4
        name = f"ids-{shard:05d}-{uuid.uuid4().hex[:12]}.bin"
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                if out is None:
                    coder = encoder(vocab)
                    fs, where = file_system(folder)
                    fs.create_dir(where, recursive=True)
                    out = fs.open_output_stream(f"{where}/{name}", compression=None)
                    width = 2 if max(len(coder.closes) - 1, end_id) < 1 << 16 else 4
                    out.write(MAGIC + np.array([1, width, 0], "<u4").tobytes())
                ids, bounds = coder.encode(*spans.text_buffer(part.column(1)), end_id)
                out.write(ids.astype(f"<u{width}").tobytes())
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(n, shard, np.int32)), pa.array([name] * n), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds))],
                    ["key", "shard", "file", "at", "n"],
                )
                at += int(bounds[-1])
        if out is not None:
            out.close()

    ordered.mapInArrow(run, f"key {kind}, shard int, file string, at bigint, n bigint").write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    totals = manifest.groupBy("shard", "file").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
    # One row per shard: the running sum is over the number of files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/shards")
    keys = spark.read.parquet(f"{path}/shards").agg(F.sum("keys")).first()[0] or 0
    buckets = max(1, -(-keys // BUCKET_KEYS))
    entries = _hashed(manifest, "key", buckets).select("bucket", "h1", "h2", "shard", "at", "n")
    entries.groupBy("bucket").applyInArrow(_build, "bucket int, buckets int, seeds binary, slots binary, entries binary").withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/index")
    return path


def _hashed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Two independent 64-bit hashes of the key, and its bucket."""
    return df.withColumns({"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit("fingerprint"), key)}).withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("int"))


def _slot(h1: np.ndarray, h2: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (spans.mixed(h1 ^ spans.mixed(h2 + seed * _STEP)) % np.uint64(n)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Displacements that send n distinct hash pairs to n distinct slots.

    Keys fall into n / 3 groups; large groups first, each tries displacements
    until its keys meet free slots.  A group of one key takes a free slot
    directly, written as a negative number.
    """
    n = len(h1)
    groups = n // 3 + 1
    group = (spans.mixed(h1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=groups)
    start = np.cumsum(size) - size
    seeds, taken = np.zeros(groups, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-size, kind="stable")
    for g in by_size[size[by_size] > 1].tolist():
        keys = order[start[g] : start[g] + size[g]]
        tried = 1
        while True:
            seed = np.arange(tried, tried + 32, dtype=np.uint64)[:, None]
            slots = _slot(h1[keys][None, :], h2[keys][None, :], seed, n)
            in_order = np.sort(slots, axis=1)
            good = np.flatnonzero(~taken[slots].any(axis=1) & (in_order[:, 1:] != in_order[:, :-1]).all(axis=1))
            if len(good):
                seeds[g] = tried + int(good[0])
                taken[slots[good[0]]] = True
                break
            tried += 32
    single = np.flatnonzero(size == 1)
    seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return seeds


def slots_of(h1: np.ndarray, h2: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[(spans.mixed(h1) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -1 - seed, _slot(h1, h2, np.maximum(seed, 0).astype(np.uint64), n))


_SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("count", "<u4")])
_ENTRY = np.dtype([("shard", "<u4"), ("n", "<u4"), ("at", "<u8")])


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _build(table: pa.Table) -> pa.Table:
    """The index row of one bucket."""
    h1, h2, shard, at, n = _columns(table, "h1", "h2", "shard", "at", "n")
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
    order = np.lexsort((at, shard, h2, h1))
    h1, h2, shard, at, n = h1[order], h2[order], shard[order], at[order], n[order]
    first = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    seeds = perfect_hash(h1[first], h2[first])
    slots = np.zeros(len(first), _SLOT)
    place = slots_of(h1[first], h2[first], seeds, len(first))
    slots["fingerprint"][place] = (h2[first] >> np.uint64(32)).astype(np.uint32)
    slots["first"][place] = first
    slots["count"][place] = np.diff(np.append(first, len(h1)))
    entries = np.zeros(len(h1), _ENTRY)
    entries["shard"], entries["n"], entries["at"] = shard, n, at
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "buckets": pa.array([0], pa.int32()),
        "seeds": [seeds.astype("<i4").tobytes()], "slots": [slots.tobytes()], "entries": [entries.tobytes()],
    })


def locate(spark: SparkSession, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, shard, file, at, n, start) of the stored documents of each key, through the index."""
    index = spark.read.parquet(f"{path}/index")
    buckets = (index.agg(F.max("buckets")).first() or [None])[0] or 1
    asked = _hashed(keys.select(F.col(key).alias("key")).distinct(), "key", buckets)
    kind = dict(asked.dtypes)["key"]

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": left.column("key").slice(0, 0), "shard": pa.array([], pa.int32()), "at": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        h1, h2 = (x.astype(np.uint64) for x in _columns(left, "h1", "h2"))
        seeds = np.frombuffer(right.column("seeds")[0].as_py(), "<i4").astype(np.int64)
        slots = np.frombuffer(right.column("slots")[0].as_py(), _SLOT)
        entries = np.frombuffer(right.column("entries")[0].as_py(), _ENTRY)
        slot = slots[slots_of(h1, h2, seeds, len(slots))]
        here = np.flatnonzero(slot["fingerprint"] == (h2 >> np.uint64(32)).astype(np.uint32))
        count = slot["count"][here].astype(np.int64)
        found = entries[spans.flat_positions(slot["first"][here].astype(np.int64), count)]
        return pa.table({
            "key": left.column("key").take(pa.array(np.repeat(here, count))), "shard": pa.array(found["shard"].astype(np.int32)),
            "at": pa.array(found["at"].astype(np.int64)), "n": pa.array(found["n"].astype(np.int64)),
        })

    found = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, f"key {kind}, shard int, at bigint, n bigint")
    shards = spark.read.parquet(f"{path}/shards").select("shard", "file", F.col("start").alias("shard_start"))
    return found.join(shards, "shard").select("key", "shard", "file", "at", "n", (F.col("shard_start") + F.col("at")).alias("start"))


def read(spark: SparkSession, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, start, n, payload) of the stored documents of each key; payload holds the ids as little-endian unsigned 32-bit."""
    where = locate(spark, path, keys, key)
    kind, folder = dict(where.dtypes)["key"], os.path.join(path, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = where.repartition(parts, "shard").sortWithinPartitions("shard", "at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, source, width = None, None, 4
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                payload = []
                for file, at, n in zip(part.column("file").to_pylist(), part.column("at").to_pylist(), part.column("n").to_pylist()):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, fs.open_input_file(f"{root}/{file}")
                        head = source.read(HEADER_BYTES)
                        if head[:4] != MAGIC:
                            raise ValueError(f"{file} is no shard")
                        width = int(np.frombuffer(head, "<u4", 1, 8)[0])
                    ids = np.frombuffer(source.read_at(width * n, HEADER_BYTES + width * at), f"<u{width}")
                    payload.append(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("start"), part.column("n"), pa.array(payload, pa.binary())], ["key", "start", "n", "payload"])
        if source is not None:
            source.close()

    return sorted_rows.mapInArrow(run, f"key {kind}, start bigint, n bigint, payload binary")
