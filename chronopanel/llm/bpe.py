"""Byte-level BPE: propose tokens greedily, test every adjacent pair, merge only what fails.

A token sequence is the BPE encoding of its text exactly if every token encodes
to itself and every adjacent pair is compatible, that is, no merge across the
joint would have come before the merges that built the two tokens.  So for all
new words of a chunk together

1. a trie walk takes the longest token at each position (numpy, all words at once),
2. the joints are tested by undoing the merges on both sides (numpy, all pairs at once),
3. words with a failing joint are merged exactly, lowest rank and leftmost first.

Texts are cut where no word of the splitting pattern can reach across, and each
distinct piece of a chunk is encoded once.  Memory per task: the vocabulary's
tables and one chunk.

Defined results: null text gives no ids and an empty decoded text; null ids stay
null keys; repeated rows are encoded like any other; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronopanel.llm import spans

#: Words longer than this go straight to exact merging; the walk would take a step per byte for a few words.
WALK_BYTES = 256
_NONE = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        for text, i in added.items():
            self.bytes[i] = text.encode()
        self.added = {text.encode().decode(): i for text, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.guard = _class("".join(added).encode()) & _SIGN
        self.words = regex.compile(pattern)
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.form = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            ab = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = (rank, ab)
            self.form[ab], self.left[ab], self.right[ab] = rank, vocab[a], vocab[b]
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        self.pair_made = np.array([t for _, t in self.pairs.values()], np.int64)[order]
        self.byte_ids = np.array(self.byte_id, np.int64)
        self._trie([i for i in vocab.values() if self.merged(self.bytes[i]) == [i]])
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.flat_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _trie(self, ids: list[int]) -> None:
        edges: dict[int, int] = {}
        accept = [-1]
        for i in ids:
            node = 0
            for b in self.bytes[i]:
                key = node << 8 | b
                if key not in edges:
                    edges[key] = len(accept)
                    accept.append(-1)
                node = edges[key]
            accept[node] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edges = keys[order]
        self.child = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.accept = np.array(accept, np.int64)

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE: the pair of lowest rank, leftmost first, one at a time."""
        ids = [self.byte_id[b] for b in word]
        pairs = self.pairs
        if len(ids) <= 48:
            while len(ids) > 1:
                best, at = (_NONE, -1), -1
                for k in range(len(ids) - 1):
                    found = pairs.get((ids[k], ids[k + 1]))
                    if found is not None and found[0] < best[0]:
                        best, at = found, k
                if at < 0:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[p], k, *p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in pairs]
        heap = [(rank, k, new, a, b) for rank, new, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (found := pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def proposed(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token at each position: (word number, token) of all words, in order."""
        at, active, words, tokens = starts.copy(), np.flatnonzero(starts < ends), [], []
        while active.size:
            node, best = np.zeros(active.size, np.int64), np.full(active.size, -1, np.int64)
            p, stop = at[active].copy(), ends[active]
            reached, live = p.copy(), np.arange(active.size)
            while live.size:
                key = node[live] << 8 | raw[p[live]]
                j = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                on = self.edges[j] == key
                live = live[on]
                node[live] = self.child[j[on]]
                p[live] += 1
                token = self.accept[node[live]]
                full = token >= 0
                best[live[full]], reached[live[full]] = token[full], p[live[full]]
                live = live[p[live] < stop[live]]
            words.append(active)
            tokens.append(best)
            at[active] = reached
            active = active[reached < stop]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the two tokens' text keeps the joint, for all pairs at once.

        Walks back in time: undo the later merge on either side of the joint and
        ask whether the pair that then met there would have merged earlier.
        """
        x, y = a.copy(), b.copy()
        ok, limit, live = np.ones(len(a), bool), np.full(len(a), _NONE, np.int64), np.arange(len(a))
        while live.size:
            early = self._ranks(x[live], y[live])[0] < limit[live]
            ok[live[early]] = False
            live = live[~early]
            fx, fy = self.form[x[live]], self.form[y[live]]
            more = (fx >= 0) | (fy >= 0)
            live, fx, fy = live[more], fx[more], fy[more]
            # The left of two equal merges comes first, so it is undone last.
            undo_left = fx > fy
            limit[live] = np.where(undo_left, fx, fy + 1)
            x[live] = np.where(undo_left, self.right[x[live]], x[live])
            y[live] = np.where(undo_left, y[live], self.left[y[live]])
        return ok

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's merge and the token it makes."""
        key = x << 32 | y
        j = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        on = self.pair_keys[j] == key
        return np.where(on, self.pair_ranks[j], _NONE), self.pair_made[j]

    def merged_words(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words, one merge in each word a round; (word number, token) in order."""
        word = np.repeat(np.arange(len(starts)), lengths)
        token = self.byte_ids[raw[spans.flat_positions(starts, lengths)]]
        rank, made = np.full(len(token), _NONE), np.zeros(len(token), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], made[inside] = self._ranks(token[inside], token[inside + 1])
        done_word, done_token = [], []
        while len(token):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(token)))
            over = np.repeat(low == _NONE, size)
            if over.any():
                done_word.append(word[over])
                done_token.append(token[over])
                word, token, rank, made = word[~over], token[~over], rank[~over], made[~over]
                low, size = low[low < _NONE], size[low < _NONE]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            token[hit] = made[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            word, token, rank, made = word[keep], token[keep], rank[keep], made[keep]
            rank[at] = _NONE
            for k in (at, at[at > 0] - 1):
                k = k[k + 1 < len(token)]
                k = k[word[k] == word[k + 1]]
                rank[k], made[k] = self._ranks(token[k], token[k + 1])
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(done_word), np.concatenate(done_token)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def encode_words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the splitting pattern: all ids end to end, and the n + 1 bounds between words."""
        lengths = ends - starts
        short = np.flatnonzero(lengths <= WALK_BYTES)
        word, token = self.proposed(raw, starts[short], ends[short])
        joint = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(token[joint] << 32 | token[joint + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        fails = np.zeros(len(short), bool)
        fails[word[joint[~good]]] = True
        again = np.flatnonzero(fails)
        exact_word, exact_token = self.merged_words(raw, starts[short[again]], lengths[short[again]])
        passed = ~fails[word]
        words, tokens = [short[word[passed]], short[again[exact_word]]], [token[passed], exact_token]
        for i in np.flatnonzero(lengths > WALK_BYTES).tolist():
            tokens.append(np.array(self.merged(raw[starts[i] : ends[i]].tobytes()), np.int64))
            words.append(np.full(len(tokens[-1]), i))
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return token[order], np.searchsorted(word[order], np.arange(len(starts) + 1))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 bounds between texts."""
        starts, ends, first = piece_spans(raw, offsets, self.guard)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        model, code = spans.distinct_spans(raw, starts, ends)
        starts, ends = starts[model], ends[model]
        odd = np.flatnonzero(~one_word(raw, starts, ends))
        # Words: the pieces that are one word, then the words found in the other pieces.
        extra: dict[bytes, int] = {}
        runs, special = [], {}
        for text in spans.span_texts(raw, starts[odd], ends[odd]):
            run = []
            for k, part in enumerate(self.split_added.split(text.decode()) if self.split_added else [text.decode()]):
                if k % 2:
                    special.setdefault(part, -1 - len(special))
                    run.append(special[part])
                else:
                    run += [extra.setdefault(w.encode(), len(extra)) for w in self.words.findall(part)]
            runs.append(run)
        tail = np.frombuffer(b"".join(extra), np.uint8)
        size = np.fromiter(map(len, extra), np.int64, len(extra))
        stop = len(raw) + np.cumsum(size)
        plain = np.ones(len(starts), bool)
        plain[odd] = False
        ids, bounds = self.encode_words(np.concatenate([raw, tail]), np.concatenate([starts[plain], stop - size]), np.concatenate([ends[plain], stop]))
        ids = np.concatenate([ids, np.array([self.added[t] for t in special], np.int64)])
        bounds = np.concatenate([bounds, bounds[-1] + 1 + np.arange(len(special))])
        words = int(plain.sum())
        # Pieces as runs of words, then texts as runs of pieces.
        count = np.ones(len(starts), np.int64)
        count[odd] = [len(run) for run in runs]
        piece_bounds = np.concatenate([[0], np.cumsum(count)])
        of_piece = np.zeros(int(piece_bounds[-1]), np.int64)
        of_piece[piece_bounds[:-1][plain]] = np.arange(words)
        known = [words + w if w >= 0 else words + len(extra) - 1 - w for run in runs for w in run]
        of_piece[spans.flat_positions(piece_bounds[:-1][odd], count[odd])] = known
        flat, lengths = spans.gathered(ids, bounds, of_piece)
        word_bounds = np.concatenate([[0], np.cumsum(lengths)])
        flat, lengths = spans.gathered(flat.astype(np.int32), word_bounds[piece_bounds], code)
        return flat, np.concatenate([[0], np.cumsum(lengths)])[first]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _class(of: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


_LETTER = _class(bytes([*range(65, 91), *range(97, 123)]))
_SIGN = _class(bytes(set(range(33, 127)) - {39} - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123))))
_PLAIN = _class(bytes(range(33, 127)))
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is C3.
_LATIN = _class(bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}))


def piece_spans(raw: np.ndarray, offsets: np.ndarray, guard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts where the splitting pattern surely ends a word, looking at neighbouring bytes only.

    Before a space between two visible characters; before and after a line feed
    between two; between a letter and a following sign; between a sign other
    than the apostrophe and a following letter; never beside a sign of `guard`, the
    signs of the added tokens.  A cut is missed beside other
    characters; the pattern itself then splits the longer piece.
    """
    n = len(raw)
    cut = np.zeros(n, bool)
    if n > 1:
        letter, sign = letter_bytes(raw), _SIGN[raw]
        visible = letter | _PLAIN[raw]
        cut[1:] = (letter[:-1] & sign[1:] | sign[:-1] & letter[1:]) & ~(guard[raw[:-1]] | guard[raw[1:]])
        space = np.zeros(n, bool)
        space[1:-1] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & visible[:-2] & visible[2:]
        cut |= space
        cut[1:] |= space[:-1] & (raw[:-1] == 10)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets)


def letter_bytes(raw: np.ndarray) -> np.ndarray:
    """Bytes of the letters A-Z, a-z and U+00C0 to U+00FF."""
    good = _LETTER[raw]
    lead = np.zeros(len(raw), bool)
    lead[:-1] = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    good |= lead
    good[1:] |= lead[:-1]
    return good


def one_word(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pieces that are one word for certain: at most one space, then ASCII and Latin-1 letters."""
    bad = np.concatenate([[0], np.cumsum(~letter_bytes(raw))])
    begin = starts + (raw[starts] == 32)
    return (bad[ends] == bad[begin]) & (begin < ends)


def decoded(vocab: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Text of each id run; bytes that are no UTF-8 become the replacement character."""
    raw, lengths = spans.gathered(vocab.flat_bytes, vocab.byte_bounds, ids.astype(np.int64))
    at = np.concatenate([[0], np.cumsum(lengths)])[bounds]
    data = raw.tobytes()
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, pattern: str | None = None, with_text: bool = False) -> DataFrame:
    """(id, ids array<int>) of every text; `with_text` adds `decoded`, the text that the ids decode to.

    No shuffle: encoding is row by row and runs where the scan runs.
    """
    path, words = vocab_path or default_vocabulary(), pattern or default_pattern()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, words)
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                ids, bounds = vocab.encode(*spans.text_buffer(part.column(1)))
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if with_text:
                    columns.append(decoded(vocab, ids, bounds))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * with_text)


def decode(ids: DataFrame, vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text, ids outside the vocabulary raise."""
    path, words = vocab_path or default_vocabulary(), pattern or default_pattern()
    kind = dict(ids.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, words)
        for batch in batches:
            lists = batch.column(1)
            lengths = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(vocab.bytes)):
                raise ValueError("an id outside the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), decoded(vocab, flat, bounds)], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
