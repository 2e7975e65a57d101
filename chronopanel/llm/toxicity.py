"""Toxicity from subword embeddings: averaged bags into a linear softmax.

A word's bag is its own bucket and those of its character n-grams; a window's
vector is the average of its distinct words' mean embeddings, missing words
counting as zero, and a two-class softmax on it gives the window's probability.  Embeddings and softmax are trained jointly, in
numpy, on labelled texts: a text's loss goes to its windows by a sharpened
maximum over them, since a few words make a text toxic however long it is.
Training windows start every six words.
Every text also comes with misspelled words; they share n-grams with the words they come from.

Scoring gives the largest probability over all windows of the whole text, one from
every word on, so words before or after a passage do not change its score.  A
text shorter than a window is one window.  More windows than in training can only
raise a maximum, so the constant is lowered, if need be, to fit the training labels.
As the layers are linear, each bucket's embedding is folded into one number first,
and the sums of all windows are running sums.  Row by row, no shuffle; the model is
that table and a constant.

Defined results: a text without words, null included, has the score of an empty
bag, which the softmax's constant sets and is below one half; without labelled
rows of both classes every text scores the share of toxic rows, at most 0.49;
repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import spans

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
WINDOW = 12
STEP = 6


def word_bags(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's bag, end to end, and the n + 1 bounds; a word is padded with one blank on each side."""
    lengths = ends - starts
    stop = np.cumsum(lengths + 2)
    begin = stop - lengths - 2
    joined = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    joined[spans.flat_positions(begin + 1, lengths)] = raw[spans.flat_positions(starts, lengths)]
    word = np.arange(len(starts))
    owner, bucket = [word], [spans.span_hashes(raw, starts, ends)]
    for n in GRAMS:
        count = np.maximum(lengths + 2 - n + 1, 0)
        at = spans.flat_positions(begin, count)
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | joined[at + k]
        owner.append(np.repeat(word, count))
        bucket.append(spans.mixed(value * np.uint64(8) + np.uint64(n)))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts)))]).astype(np.int64)


def _letters(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII signs at their ends."""
    sign = (raw > 32) & (raw < 127) & ~((raw >= 48) & (raw <= 57)) & ~((raw >= 97) & (raw <= 122)) & ~((raw >= 65) & (raw <= 90))
    other = np.flatnonzero(~sign)
    first = np.searchsorted(other, starts)
    last = np.searchsorted(other, ends) - 1
    bare = (first > last) | (len(other) == 0)
    if len(other):
        starts = np.where(bare, starts, other[np.minimum(first, len(other) - 1)])
        ends = np.where(bare, ends, other[last] + 1)
    return starts, ends


def _chunk_words(texts: pa.Array):
    """Distinct words' bags, each word's number, and each text's first word."""
    raw, offsets = spans.text_buffer(texts)
    raw = spans.lowered(raw)
    starts, ends, first = spans.word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), first
    starts, ends = _letters(raw, starts, ends)
    model, code = spans.distinct_spans(raw, starts, ends)
    bags, bounds = word_bags(raw, starts[model], ends[model])
    return bags, bounds, code, first


def _windows(first: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows: the distinct (window, word) pairs as two columns, and each window's text."""
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(1, -(-(words - WINDOW) // STEP) + 1), 0)
    inside = np.arange(len(code)) - np.repeat(first[:-1], words)
    start, most = np.repeat(np.cumsum(count) - count, words), np.repeat(count, words)
    window, held = [], []
    for back in range(WINDOW // STEP):
        own = inside // STEP - back
        ok = (own >= 0) & (own < most)
        window.append(start[ok] + own[ok])
        held.append(code[ok])
    kinds = int(code.max()) + 1 if len(code) else 1
    pair = pd.unique(np.concatenate(window) * kinds + np.concatenate(held))
    return pair // kinds, pair % kinds, np.repeat(np.arange(len(words)), count)


def _largest(first: np.ndarray, code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Each text's largest sum of `word` over the distinct words of a window, over all starts; minus infinity without words.

    A word counts in the windows that begin after its previous occurrence: one
    step up where they begin, one down behind them, and a running sum.
    """
    words = np.diff(first)
    text, at = np.repeat(np.arange(len(words)), words), np.arange(len(code))
    key = text * (int(code.max()) + 1 if len(code) else 1) + code
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    before = np.full(len(code), -1)
    before[order[1:][again]] = order[:-1][again]
    value = word[code].astype(float)
    begin = np.maximum(np.maximum(first[text], at - WINDOW + 1), before + 1)
    steps = np.bincount(begin, weights=value, minlength=len(code) + 1)
    steps[1:] -= value
    sums = np.cumsum(steps[:-1])
    whole = at <= np.maximum(first[text], first[text + 1] - WINDOW)
    best = np.full(len(words), -np.inf)
    np.maximum.at(best, text[whole], sums[whole])
    return best


def misspelled(text: str, rng: np.random.Generator, share: float = 0.3) -> str:
    """One letter replaced, dropped or doubled in a share of the longer words."""
    words = text.split(" ")
    for k in np.flatnonzero(rng.random(len(words)) < share).tolist():
        w = words[k]
        if len(w) > 4:
            at, kind = int(rng.integers(1, len(w) - 1)), int(rng.integers(3))
            words[k] = w[:at] + (chr(int(rng.integers(97, 123))) + w[at + 1 :], w[at + 1 :], w[at] + w[at:])[kind]
    return " ".join(words)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shift(z: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """What is added to the log odds for the least weighted log loss, zero at most."""
    move = 0.0
    for _ in range(50):
        p = _sigmoid(z + move)
        move += float(np.clip(weight @ (labels - p) / max(float(weight @ (p * (1 - p))), 1e-6), -1, 1))
    return min(move, 0.0)


@dataclass
class Model:
    table: np.ndarray | None
    constant: float

    def logits(self, bags: np.ndarray, bounds: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of the words of a chunk's texts."""
        if not len(code):
            return np.full(len(first) - 1, self.constant)
        word = np.add.reduceat(self.table[bags], bounds[:-1], dtype=float) / np.diff(bounds)
        best = _largest(first, code, word) / WINDOW
        return np.where(np.isfinite(best), best, 0.0) + self.constant

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.constant)
        return _sigmoid(self.logits(*_chunk_words(texts)))


def fit(sample: list[tuple[str, int]], dim: int = 4, rounds: int = 25, rate: float = 0.5, least_texts: int = 3, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax, all texts at once.

    Embeddings start along one random direction, at the smoothed log odds of
    their bucket among toxic and other texts, and both layers then follow the
    gradient of the pooled loss.  Buckets of fewer than `least_texts` texts stay zero.
    """
    labels = np.array([v for _, v in sample], float)
    if len(set(labels)) < 2:
        return Model(None, float(min(labels.mean(), 0.49)) if len(labels) else 0.0)
    # Misspelled copies make the n-grams answer for a word where its own bucket is unknown.
    rng = np.random.default_rng(seed)
    labels = np.concatenate([labels, labels])
    bags, bounds, code, first = _chunk_words(pa.array([t for t, _ in sample] + [misspelled(t, rng) for t, _ in sample], pa.string()))
    if not len(code):
        return Model(None, float(min(labels.mean(), 0.49)))
    window, own, text = _windows(first, code)
    bag_size = np.diff(bounds)
    # Texts of each bucket, by label, a few texts at a time.
    seen = np.zeros((2, BUCKETS))
    for t in range(len(labels)):
        pieces, _ = spans.gathered(bags, bounds, np.unique(code[first[t] : first[t + 1]]))
        seen[int(labels[t]), np.unique(pieces)] += 1
    odds = np.log((seen[1] + 1) / (labels.sum() + 2)) - np.log((seen[0] + 1) / (len(labels) - labels.sum() + 2))
    slot = np.full(BUCKETS, -1)
    used = np.flatnonzero(seen[0] + seen[1] >= least_texts)
    slot[used] = np.arange(len(used))
    trained = slot[bags] >= 0
    slots = slot[bags[trained]].astype(np.int32)
    owner = np.repeat(np.arange(len(bag_size), dtype=np.int32), bag_size)[trained]
    del trained
    softmax = rng.normal(0, 0.5, (2, dim))
    along = softmax[1] - softmax[0]
    embed = rng.normal(0, 0.01, (len(used), dim)) + WINDOW * np.outer(odds[used], along / (along @ along))
    bias = np.array([1.0, -1.0])
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embed, softmax, bias)]
    has_words = np.diff(first) > 0

    def summed(index: np.ndarray, values: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
        """Rows of `values` at `source`, added up by `index`; one dimension at a time."""
        return np.stack([np.bincount(index, weights=values[source, d], minlength=n) for d in range(dim)], axis=1)

    for step in range(1, rounds + 1):
        words = summed(owner, embed, slots, len(bag_size)) / bag_size[:, None]
        vector = summed(window, words, own, len(text)) / WINDOW
        logits = vector @ softmax.T + bias
        z = logits[:, 1] - logits[:, 0]
        top = np.full(len(labels), -np.inf)
        np.maximum.at(top, text, z)
        share = np.exp(np.clip(4 * (z - top[text]), -60, 0))
        share /= np.bincount(text, weights=share, minlength=len(labels))[text]
        pooled = np.bincount(text, weights=share * z, minlength=len(labels))
        p = 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))
        grad_z = (weight * (p - labels) * has_words)[text] * share
        grad_logits = np.stack([-grad_z, grad_z], axis=1)
        spread = (grad_logits @ softmax) / WINDOW
        grad_word = summed(own, spread, window, len(bag_size)) / bag_size[:, None]
        grads = summed(slots, grad_word, owner, len(used)), grad_logits.T @ vector, grad_logits.sum(axis=0)
        for (m, v), value, grad, lr in zip(state, (embed, softmax, bias), grads, (rate, rate / 20, rate / 5)):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            scale = np.sqrt(v / (1 - 0.98**step))
            value -= lr * (m / (1 - 0.9**step)) / (scale + 0.05 * scale.max() + 1e-12)
    table = np.zeros(BUCKETS)
    table[used] = embed @ (softmax[1] - softmax[0])
    model = Model(table.astype(np.float32), float(bias[1] - bias[0]))
    # The texts as they are; their misspelled copies come behind them.
    given = len(sample)
    half = labels[:given], weight[:given]
    model.constant += _shift(model.logits(bags, bounds, code[: first[given]], first[: given + 1]), *half)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                p = model.scores(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
