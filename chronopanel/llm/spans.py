"""Word spans of Arrow text batches as numpy arrays, without an object per word.

Texts of a batch stay in one byte buffer.  A word is a pair of byte positions,
so splitting, comparing and counting words are array operations whose memory is
bounded by `CHUNK_BYTES` of text (or one longer text) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about this many bytes; one text is never cut.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Masks that keep the first 0 … 8 bytes of a little-endian number.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 positions between texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `size` bytes of text, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; no other byte changes."""
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's first word (n + 1 entries).

    `space` tells of each of the 256 bytes whether it stands between words; as given, words are `[^\\x20\\x09-\\x0D]+`.
    """
    ink = ~space[raw]
    before = np.zeros_like(ink)
    before[1:] = ink[:-1]
    inner = offsets[offsets < len(raw)]
    before[inner] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.zeros_like(ink)
    after[:-1] = ink[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _octets(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number, zeros after the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def _lanes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Eight bytes of the spans at a time: (numbers of the spans that reach so far, their bytes)."""
    octets, at = _octets(raw), 0
    longest = int(lengths.max()) if len(lengths) else 0
    live = np.arange(len(starts))
    while at < longest:
        if at:
            live = live[lengths[live] > at]
        yield live, octets[starts[live] + at] & _KEEP[np.minimum(lengths[live] - at, 8)]
        at += 8


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal wherever the bytes are equal."""
    lengths = ends - starts
    h = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for live, lane in _lanes(raw, starts, lengths):
        x = (h[live] ^ lane) * np.uint64(0xD6E8FEB86659FD93)
        h[live] = x ^ (x >> np.uint64(32))
    return mixed(h)


def flat_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each distinct text, and for each span the number of its text.

    Hashes find the classes; every span's bytes are then compared with its
    class's first span, and a collision falls back to comparing the texts.
    """
    code, kinds = pd.factorize(span_hashes(raw, starts, ends))
    first = _first_of(code, len(kinds))
    lengths, model = ends - starts, first[code]
    octets = _octets(raw)
    if np.array_equal(lengths, lengths[model]) and all(
        np.array_equal(lane, octets[starts[model[live]] + 8 * k] & _KEEP[np.minimum(lengths[live] - 8 * k, 8)]) for k, (live, lane) in enumerate(_lanes(raw, starts, lengths))
    ):
        return first, code
    data, seen = raw.tobytes(), {}
    code = np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts, ends)), np.int64, len(starts))
    return _first_of(code, len(seen)), code


class Lexicon:
    """Known words with a number each; `kinds` tells equal words of several lists apart."""

    def __init__(self, words: list[bytes], kinds: np.ndarray | None = None):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.raw = np.frombuffer(bytearray(b"".join(words)), np.uint8) if self.ends.any() else np.zeros(0, np.uint8)
        self.kinds = np.zeros(len(words), np.int64) if kinds is None else kinds
        hashes = self._hashes(self.raw, self.starts, self.ends, self.kinds)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    @staticmethod
    def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return mixed(span_hashes(raw, starts, ends) + kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
        """The number of each span's word, -1 if it is unknown; found by hash, then compared byte by byte."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        kinds = np.zeros(len(starts), np.int64) if kinds is None else kinds
        h = self._hashes(raw, starts, ends, kinds)
        slot = np.searchsorted(self.hashes, h)
        open_ = np.flatnonzero(self.hashes[np.minimum(slot, len(self.hashes) - 1)] == h)
        mine, theirs = _octets(raw), _octets(self.raw)
        while len(open_):
            word = self.order[slot[open_]]
            lengths = ends[open_] - starts[open_]
            same = (lengths == self.ends[word] - self.starts[word]) & (kinds[open_] == self.kinds[word])
            live, at = np.flatnonzero(same), 0
            while len(live := live[lengths[live] > at]):
                keep = _KEEP[np.minimum(lengths[live] - at, 8)]
                same[live] = (mine[starts[open_[live]] + at] & keep) == (theirs[self.starts[word[live]] + at] & keep)
                live, at = live[same[live]], at + 8
            out[open_[same]] = word[same]
            # Another word with the same hash stands next.
            open_ = open_[~same]
            slot[open_] += 1
            open_ = open_[(slot[open_] < len(self.hashes))]
            open_ = open_[self.hashes[slot[open_]] == h[open_]]
        return out


def _first_of(code: np.ndarray, kinds: int) -> np.ndarray:
    first = np.empty(kinds, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first


def span_texts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def gathered(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs values[bounds[c]:bounds[c + 1]] of codes c; also each run's length."""
    lengths = (bounds[1:] - bounds[:-1])[codes]
    return values[flat_positions(bounds[:-1][codes], lengths)], lengths
