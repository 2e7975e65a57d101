"""Quality rules on repetition: a suffix array over the words of every text.

Suffixes are sorted by prefix doubling, all texts of a chunk at once; ranks
carry the text, so a repeat lies inside one text.  The common prefixes of
neighbours in the array give each position its longest repeated string, and the
strings of at least `min_words` words are united to spans.  Only suffixes whose
group still has company are sorted again, so ordinary prose takes two or three
rounds and a text of copies takes as many as the logarithm of its copy length.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronopanel.llm import spans

#: Fixed values of the base rule.
BASE_WINDOW, BASE_MIN_WORDS, BASE_PERCENT = 8, 20, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_ranks(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of all texts, and the ranks after 1, 2, 4, … words.

    Equal ranks at level k mean equal first 2**k words in the same text.
    """
    n = len(code)
    key = doc * (int(code.max()) + 1 if n else 1) + code
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order[1:]] != key[order[:-1]]) if n else np.zeros(0, bool)
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    size = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, size)
    levels = [rank]
    slots, k = np.flatnonzero(np.repeat(size > 1, size)), 1
    while len(slots):
        item = order[slots]
        ahead = item + k
        inside = ahead < n
        second = np.full(len(item), -1, np.int64)
        second[inside] = np.where(doc[ahead[inside]] == doc[item[inside]], rank[ahead[inside]], -1)
        first = rank[item]
        turn = np.lexsort((second, first))
        item, first, second = item[turn], first[turn], second[turn]
        order[slots] = item
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(item)))
        rank = rank.copy()
        rank[item] = np.repeat(slots[head], size)
        levels.append(rank)
        slots, k = slots[np.repeat(size > 1, size)], 2 * k
    return order, levels


def longest_repeats(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length in words of the longest string there that the text has elsewhere too."""
    n = len(code)
    longest = np.zeros(n + 1, np.int64)
    if n > 1:
        order, levels = suffix_ranks(code, doc)
        a, b = order[:-1].copy(), order[1:].copy()
        pair = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b = a[pair], b[pair]
        common = np.zeros(len(pair), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            rank, step = np.append(levels[level], [-1, -2]), 1 << level
            same = rank[np.minimum(a + common, n)] == rank[np.where(b + common < n, b + common, n + 1)]
            common += step * same
        np.maximum.at(longest, a, common)
        np.maximum.at(longest, b, common)
    return longest[:n]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions inside a repeated string of at least `least` words."""
    start = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + longest[start], -1)
    return np.cumsum(edge[:-1]) > 0


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _duplicate_lines(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    feeds = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    stop = np.append(begin[1:], len(raw))
    # A line ends before its feed or at the end of its text.
    stop = stop - ((stop > begin) & (raw[np.maximum(stop - 1, 0)] == 10) if len(raw) else 0)
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[worded], stop[worded]
    n = len(offsets) - 1
    if not len(begin):
        return np.zeros(n, np.int64)
    code = spans.distinct_spans(raw, begin, stop)[1]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    each = np.unique(doc * (int(code.max()) + 1) + code)
    return np.bincount(doc, minlength=n) - np.bincount(each // (int(code.max()) + 1), minlength=n)


def measure(texts: pa.Array, min_words: int) -> dict[str, np.ndarray]:
    """All counts of every text of a chunk."""
    raw, offsets = spans.text_buffer(texts)
    starts, ends, first = spans.word_spans(raw, offsets)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    code = spans.distinct_spans(raw, starts, ends)[1] if len(starts) else np.zeros(0, np.int64)
    longest = longest_repeats(code, doc)
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, doc, longest)
    # Continuation bytes of UTF-8 do not start a character.
    inked = _per_text(((raw & 0xC0) != 0x80) & ~spans._SPACE[raw], offsets)
    return {
        "n_words": words,
        "word_chars": inked,
        "n_symbols": _per_text(_SYMBOL[raw], offsets),
        "n_dup_lines": _duplicate_lines(raw, offsets, starts),
        "n_repeat_words": _per_text(covered(longest, BASE_WINDOW), first),
        "n_covered_words": _per_text(covered(longest, min_words), first),
        "longest_repeat": most,
    }


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, max_covered: float = 0.3, max_longest: int = 50) -> DataFrame:
    """(id, the counts of `measure`, base_failed, kept) of every text.

    kept: the base rule holds, at most the share `max_covered` of the words lies in
    repeated strings of `min_words` words or more, and the longest repeated
    string has at most `max_longest` words.  No shuffle.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                got = measure(part.column(1), min_words)
                n = got["n_words"]
                failed = (n < BASE_MIN_WORDS) | (100 * got["n_repeat_words"] > BASE_PERCENT * n)
                kept = ~failed & (got["n_covered_words"] <= np.round(max_covered * n, 9)) & (got["longest_repeat"] <= max_longest)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c in counts), pa.array(failed), pa.array(kept)], ["doc_id", *counts, "base_failed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, kept boolean")
