"""Language-model scores from a log-frequency Bloom filter, beside an exact unigram base.

Learning: the counts of all one- and two-token strings of the training texts are
combined per task, shuffled as packed keys to segments, summed, and quantised to
level 1 + floor(log(count) / log(ratio)).  A string of level q enters its
segment's Bloom filter q times, with its levels 1 … q; a segment is a file in
the shared folder whose content does not depend on order or attempt.

Scoring: a string's level is found by probing levels 1, 2, … until one is
absent.  With c() the count at a level's middle, the probability of w after v is

    share * c(v w) / c(v) + (1 - share) * (c(w) + 0.5) / (N + 0.5 * (V + 1)),

the first share falling away where c(v) = 0.  Workers get the whole filter as a
broadcast while its measured size is within `broadcast_bytes`; beyond that they
open one segment at a time from the shared folder, each once for a block of texts,
and get the same levels.

Base: exact counts.  Every block of texts sends its distinct words, once each, to
word segments, gets their training counts back, and sums per document.  Nothing
depends on how often a word occurs, and no vocabulary is held in one place.

Defined results: null and empty texts are the end token alone; a null id is
never held out; repeated rows are scored and counted each; with no training
text, nothing is known and every token has the base probability 0.5 / 0.5 = 1;
other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import spans
from chronopanel.llm.shared import file_system, shared_path, stored

#: Text bytes worked up together in one task.
BLOCK_BYTES = 8 << 20
#: Counted strings that a task holds before it sends them.
HELD_KEYS = 2_000_000
#: Text bytes per segment on average; sets the number of segments from the input.
SEGMENT_BYTES = 16 << 20
PROBES = 7
TOP_LEVEL = 80
_START, _END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW48 = np.uint64((1 << 48) - 1)


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return spans.mixed(before * np.uint64(0x9E3779B97F4A7C15) + token)


def single_keys(token: np.ndarray) -> np.ndarray:
    return spans.mixed(token ^ np.uint64(0xA0761D6478BD642F))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) * np.uint64(segments) >> np.uint64(16)).astype(np.int64)


def token_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts (words, then the end), what stands before each, and the n + 1 bounds."""
    n = len(first) - 1
    bounds = first + np.arange(n + 1)
    token = np.insert(hashes, first[1:], _END)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[bounds[:-1]] = _START
    return token, before, bounds


def level_of(count: np.ndarray, ratio: float) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(count) / np.log(ratio) + 1e-9).astype(np.int64), TOP_LEVEL)


def level_counts(ratio: float) -> np.ndarray:
    """The count that stands for each level; level 0 is absent."""
    q = np.arange(TOP_LEVEL + 1)
    low = np.ceil(ratio ** (q - 1.0) - 1e-9)
    high = np.maximum(np.ceil(ratio**q - 1e-9) - 1, low)
    return np.where(q == 0, 0.0, (low + high) / 2)


def _seeds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every key, from which all its places follow."""
    keys = keys & _LOW48
    return spans.mixed(keys + np.uint64(0x2545F4914F6CDD1D)), spans.mixed(keys ^ np.uint64(0x9E6C63D0876A9A75)) | np.uint64(1)


def _places(a: np.ndarray, b: np.ndarray, number: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The place of a numbered probe in a filter of so many bits, below 2**32."""
    x = a + b * np.uint64(number) + np.uint64(number * number * 0x1B873593)
    return ((x >> np.uint64(32)) * bits >> np.uint64(32)).astype(np.int64)


def packed_filter(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The Bloom filter of one segment; first 8 bytes its number of bits."""
    size = 64 * (int(level.sum() * PROBES / np.log(2)) // 64 + 1)
    held = np.zeros(size, bool)
    first, second = _seeds(keys)
    for q in range(1, int(level.max(initial=0)) + 1):
        live = level >= q
        for i in range(PROBES):
            held[_places(first[live], second[live], q * PROBES + i, np.uint64(size))] = True
    return np.concatenate([np.array([size], "<u8").view(np.uint8), np.packbits(held)])


class Filter:
    """Segments first … of the filter, end to end in one byte array."""

    def __init__(self, flat: np.ndarray, sizes: list[int]):
        self.flat = flat
        self.start = np.cumsum(sizes) - sizes
        self.bits = np.array([int(flat[a : a + 8].view("<u8")[0]) for a in self.start.tolist()], np.int64)

    def levels(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        level, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        state = [live, 8 * (self.start[segment] + 8), self.bits[segment].astype(np.uint64), *_seeds(keys)]
        for q in range(1, TOP_LEVEL + 1):
            for i in range(PROBES):
                _, start, bits, a, b = state
                at = start + _places(a, b, q * PROBES + i, bits)
                held = (self.flat[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                state = [x[held] for x in state]
            if not len(state[0]):
                break
            level[state[0]] = q
        return level


def _segment_file(folder: str, segment: int) -> str:
    return f"{folder}/segment-{segment:07d}.bin"


def _load(folder: str, segment: int) -> np.ndarray:
    fs, root = file_system(folder)
    with fs.open_input_file(_segment_file(root, segment)) as f:
        return np.frombuffer(f.read(), np.uint8)


def _one(data: np.ndarray) -> Filter:
    return Filter(data, [len(data)])


def find_levels(keys: np.ndarray, segments: int, whole: Filter | None, folder: str) -> np.ndarray:
    segment = segment_of(keys, segments)
    if whole is not None:
        return whole.levels(keys, segment)
    level, order = np.zeros(len(keys), np.int64), np.argsort(segment, kind="stable")
    edge = np.searchsorted(segment[order], np.arange(segments + 1))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        own = order[edge[s] : edge[s + 1]]
        level[own] = _one(_load(folder, s)).levels(keys[own], np.zeros(len(own), np.int64))
    return level


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of chunks with about BLOCK_BYTES of text."""
    block, size = [], 0
    for batch in batches:
        for part in spans.chunks(batch, "text"):
            block.append(part)
            size += part.column(part.schema.get_field_index("text")).nbytes
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def _hashed(part: pa.RecordBatch):
    raw, offsets = spans.text_buffer(part.column(part.schema.get_field_index("text")))
    raw = spans.lowered(raw)
    starts, ends, first = spans.word_spans(raw, offsets)
    return raw, starts, ends, first, (spans.span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64))


def learn(rows: DataFrame, folder: str, segments: int, ratio: float) -> DataFrame:
    """Write the filter's segments below `folder`; (segment, bytes, tokens, words) of each segment."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {1: [], 0: []}
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                _, _, _, first, hashes = _hashed(part)
                token, before, _ = token_hashes(hashes, first)
                for single, keys in ((1, single_keys(token)), (0, pair_keys(before, token))):
                    held[single].append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in held[single]) > HELD_KEYS:
                        held[single] = [_summed(held[single])]
                        if len(held[single][0][0]) > HELD_KEYS // 2:
                            yield _sent(single, *held[single].pop())
        for single, counted in held.items():
            if counted:
                yield _sent(single, *_summed(counted))

    def _sent(single: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """One row for every segment that has strings; `single` tells tokens from pairs when a segment sums N and V."""
        segment = segment_of(key, segments)
        edge = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        stop = np.append(edge[1:], len(key))
        octets = key.view(np.uint8).reshape(-1, 8)[:, :6]
        return pa.RecordBatch.from_arrays([
            pa.array(segment[edge].astype(np.int32)), pa.array([single] * len(edge), pa.int32()),
            pa.array([octets[a:b].tobytes() for a, b in zip(edge, stop)], pa.binary()),
            pa.array([_packed_counts(n[a:b]) for a, b in zip(edge, stop)], pa.binary()),
        ], ["segment", "single", "keys", "counts"])

    def build(table: pa.Table) -> pa.Table:
        segment, sums = table.column("segment")[0].as_py(), []
        for single in (1, 0):
            own = table.filter(pc.equal(table.column("single"), single))
            key = np.concatenate([_wide(b.as_py()) for b in own.column("keys")] or [np.zeros(0, np.uint64)])
            n = np.concatenate([_counts(b.as_py()) for b in own.column("counts")] or [np.zeros(0, np.int64)])
            key, code = np.unique(key, return_inverse=True)
            sums.append((key, np.bincount(code, weights=n, minlength=len(key)).astype(np.int64)))
        key, total = (np.concatenate(x) for x in zip(*sums))
        data = packed_filter(key, level_of(total, ratio))
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        own_name = f"{root}/part-{uuid.uuid4().hex}"
        with fs.open_output_stream(own_name, compression=None) as f:
            f.write(data.tobytes())
        fs.move(own_name, _segment_file(root, segment))
        return pa.table({"segment": pa.array([segment], pa.int32()), "bytes": [len(data)], "tokens": [int(sums[0][1].sum())], "words": [len(sums[0][0])]})

    counted = rows.where("train").select("text").mapInArrow(count, "segment int, single int, keys binary, counts binary")
    # Every segment gets a file, also one that no string falls into.
    empty = rows.sparkSession.range(segments).selectExpr("CAST(id AS int) AS segment", "1 AS single", "X'' AS keys", "X'' AS counts")
    return stored(counted.union(empty).groupBy("segment").applyInArrow(build, "segment int, bytes bigint, tokens bigint, words bigint"), "lm-segments")


def _summed(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, from several such lists."""
    key, n = (np.concatenate(x) for x in zip(*counted))
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[head], np.add.reduceat(n[order], head)


def _packed_counts(n: np.ndarray) -> bytes:
    """One byte per count; 255 announces a four-byte count after the bytes."""
    large = n >= 255
    return np.array([len(n)], "<u4").tobytes() + np.where(large, 255, n).astype(np.uint8).tobytes() + n[large].astype("<u4").tobytes()


def _counts(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    size = int(np.frombuffer(data, "<u4", 1)[0])
    n = np.frombuffer(data, np.uint8, size, 4).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<u4", offset=4 + size)
    return n


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


_unpacked: dict[str, Filter] = {}


def _whole(folder: str, shared) -> Filter | None:
    """The broadcast filter, unpacked once in each worker."""
    if shared is None:
        return None
    if folder not in _unpacked:
        _unpacked.clear()
        data, sizes = shared.value
        _unpacked[folder] = Filter(np.frombuffer(data, np.uint8), sizes)
    return _unpacked[folder]


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", ratio: float = 1.5, share: float = 0.3, broadcast_bytes: int = 192 << 20) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows where `train` holds.

    Scores are log10 probabilities of the whole text with its end.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = dict(rows.dtypes)["doc_id"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, -(-size // SEGMENT_BYTES))
    folder = shared_path(spark, "lm-filter")
    built = learn(rows, folder, segments, ratio).agg(F.sum("bytes"), F.sum("tokens"), F.sum("words")).first()
    shared = None
    if built[0] <= broadcast_bytes:
        parts = [_load(folder, s) for s in range(segments)]
        shared = spark.sparkContext.broadcast((b"".join(parts), [len(p) for p in parts]))
        del parts
    n_all, n_words, count_at = built[1] or 0, built[2] or 0, level_counts(ratio)
    floor = n_all + 0.5 * (n_words + 1)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, number = _whole(folder, shared), TaskContext.get().partitionId() << 24
        for block in _blocks(batches):
            number += 1
            yield from _block_rows(block, number, segments, whole, folder, count_at, floor, share)

    blob = "uid bigint, segment int, words string, counts binary, n int, doc_id array<" + kind + ">, train binary, n_tokens binary, score binary, bounds binary, code binary, tf binary"
    table = stored(rows.mapInArrow(work, blob), "lm-blocks")
    if shared is not None:
        # The blocks are stored, so no task reads the filter again.
        shared.unpersist(blocking=True)
    known = stored(table.where("segment >= 0").select("uid", "segment", "words", "counts").groupBy("segment").applyInArrow(_word_counts, "uid bigint, segment int, counts binary, tokens bigint, words bigint"), "lm-counts")
    texts = table.where("segment < 0")
    n_tokens, n_distinct = known.agg(F.sum("tokens"), F.sum("words")).first()
    n_end = texts.agg(F.sum("n")).first()[0] or 0
    n_tokens, n_distinct = (n_tokens or 0) + n_end, (n_distinct or 0) + (n_end > 0)
    names = ["doc_id", "train", "n_tokens", "score", "bounds", "code", "tf"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("segment")
        c = np.concatenate([_counts8(b.as_py()) for b in right.column("counts")] or [np.zeros(0, np.int64)])
        row = {x: left.column(x)[0] for x in names}
        tokens, bounds = np.frombuffer(row["n_tokens"].as_py(), "<i8"), np.frombuffer(row["bounds"].as_py(), "<i8")
        code, tf = np.frombuffer(row["code"].as_py(), "<u4"), np.frombuffer(row["tf"].as_py(), "<u4").astype(np.int64)
        own = np.repeat(np.arange(len(tokens)), np.diff(bounds))
        logs = np.bincount(own, weights=tf * np.log10(c[code] + 0.5), minlength=len(tokens)) + np.log10(n_end + 0.5)
        seen = np.bincount(own, weights=tf * (c[code] > 0), minlength=len(tokens)).astype(np.int64) + (n_end > 0)
        return pa.table({
            "doc_id": row["doc_id"].values, "train": np.frombuffer(row["train"].as_py(), np.uint8) == 1, "n_tokens": tokens, "n_known": seen,
            "train_tokens": np.full(len(tokens), n_tokens), "base_score": logs - tokens * np.log10(n_tokens + 0.5 * (n_distinct + 1)), "score": np.frombuffer(row["score"].as_py(), "<f8"),
        })

    return texts.select("uid", *names).groupBy("uid").cogroup(known.select("uid", "segment", "counts").groupBy("uid")).applyInArrow(
        finish, f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def _counts8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _levels_of(block: list, segments: int, whole: Filter | None, folder: str):
    """A function from keys to their levels.

    Without the whole filter, the distinct keys of all chunks of the block are
    found first, so that every segment is opened once a block.
    """
    if whole is not None:

        def probe(keys: np.ndarray) -> np.ndarray:
            code, distinct = pd.factorize(keys)
            return whole.levels(distinct, segment_of(distinct, segments))[code]

        return probe
    known = np.zeros(0, np.uint64)
    for part in block:
        _, _, _, first, hashes = _hashed(part)
        token, before, _ = token_hashes(hashes, first)
        known = np.union1d(known, np.concatenate([single_keys(token), pair_keys(before, token)]))
    levels = find_levels(known, segments, None, folder).astype(np.int8)
    return lambda keys: levels[np.searchsorted(known, keys)]


def _scores(token: np.ndarray, before: np.ndarray, bounds: np.ndarray, levels_of, count_at: np.ndarray, floor: float, share: float) -> np.ndarray:
    """The log10 probability of every text of a chunk."""
    single, pair = count_at[levels_of(np.concatenate([single_keys(token), pair_keys(before, token)]))].reshape(2, -1)
    base = (single + 0.5) / floor
    # The start of a text is no token: what follows it has the base alone.
    context = np.append(0.0, single[:-1])
    context[bounds[:-1]] = 0.0
    p = np.where(context > 0, share * np.minimum(pair / np.maximum(context, 1), 1) + (1 - share) * base, base)
    return np.add.reduceat(np.log10(p), bounds[:-1])


def _block_rows(block: list[pa.RecordBatch], uid: int, segments: int, whole: Filter | None, folder: str, count_at: np.ndarray, floor: float, share: float) -> Iterator[pa.RecordBatch]:
    """A block's words by segment, and one row with its documents' scores and word counts."""
    words: dict[bytes, int] = {}
    word_hash, word_train, scores, sizes, owners, codes, tfs = [], [], [], [], [], [], []
    flags, ids, before_docs = [], [], 0
    levels_of = _levels_of(block, segments, whole, folder)
    for part in block:
        raw, starts, ends, first, hashes = _hashed(part)
        token, before, bounds = token_hashes(hashes, first)
        sizes.append(np.diff(bounds))
        scores.append(_scores(token, before, bounds, levels_of, count_at, floor, share))
        train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
        flags.append(train)
        ids.append(part.column(0))
        if len(starts):
            model, code = spans.distinct_spans(raw, starts, ends)
            texts = spans.span_texts(raw, starts[model], ends[model])
            known = len(words)
            place = np.fromiter((words.setdefault(w, len(words)) for w in texts), np.int64, len(texts))
            fresh = place >= known
            new_hash = np.zeros(len(words) - known, np.uint64)
            new_hash[place[fresh] - known] = hashes[model[fresh]]
            word_hash.append(new_hash)
            doc = np.repeat(np.arange(len(train)), np.diff(first))
            cell, n = np.unique(doc * len(words) + place[code], return_counts=True)
            owner, own = cell // len(words), cell % len(words)
            owners.append(owner + before_docs)
            codes.append(own)
            tfs.append(n)
            word_train.append(np.bincount(own, weights=n * train[owner], minlength=len(words)))
        before_docs += len(part)
    size, score = np.concatenate(sizes), np.concatenate(scores)
    all_ids = pa.concat_arrays(ids)
    if words:
        hashes = np.concatenate(word_hash)
        train_count = np.zeros(len(words))
        for x in word_train:
            train_count[: len(x)] += x
        segment = segment_of(hashes, segments)
        order = np.argsort(segment, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        texts, edge = list(words), np.searchsorted(segment[order], np.arange(segments + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            own = order[edge[s] : edge[s + 1]]
            yield _row(all_ids, uid=uid, segment=s, words=b" ".join([texts[k] for k in own.tolist()]).decode(), counts=train_count[own].astype("<u4").tobytes())
        owner, own, n = np.concatenate(owners), place[np.concatenate(codes)], np.concatenate(tfs)
    else:
        owner = own = n = np.zeros(0, np.int64)
    train = np.concatenate(flags)
    bounds = np.searchsorted(owner, np.arange(len(train) + 1))
    yield _row(
        all_ids, uid=uid, segment=-1, n=int(train.sum()), train=train.astype(np.uint8).tobytes(), n_tokens=size.astype("<i8").tobytes(), score=score.astype("<f8").tobytes(),
        bounds=bounds.astype("<i8").tobytes(), code=own.astype("<u4").tobytes(), tf=n.astype("<u4").tobytes(),
    )


def _row(ids: pa.Array, **given) -> pa.RecordBatch:
    kinds = {"uid": pa.int64(), "segment": pa.int32(), "words": pa.string(), "counts": pa.binary(), "n": pa.int32(), "doc_id": None, **dict.fromkeys(["train", "n_tokens", "score", "bounds", "code", "tf"], pa.binary())}
    columns = []
    for name, kind in kinds.items():
        value = given.get(name)
        if name == "doc_id":
            # A block's ids are one list; the other rows have none.
            value = ids if given["segment"] < 0 else ids.slice(0, 0)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value))
        else:
            columns.append(pa.array([value], kind))
    return pa.RecordBatch.from_arrays(columns, list(kinds))


def _word_counts(table: pa.Table) -> pa.Table:
    """The training count of every word of a segment, in the order in which each block sent its words."""
    lists = pc.split_pattern(table.column("words").combine_chunks(), " ")
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    sent = np.concatenate([np.frombuffer(b.as_py(), "<u4") for b in table.column("counts")])
    total = np.bincount(code, weights=sent, minlength=len(coded.dictionary)).astype("<i8")
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    each = total[code]
    n = table.num_rows
    return pa.table({
        "uid": table.column("uid"), "segment": table.column("segment"), "counts": pa.array([each[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)], pa.binary()),
        "tokens": np.append(int(total.sum()), np.zeros(n - 1, np.int64)), "words": np.append(int((total > 0).sum()), np.zeros(n - 1, np.int64)),
    })
