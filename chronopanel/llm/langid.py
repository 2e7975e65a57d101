"""Language identification by error-correcting output codes.

Every language gets a codeword of bits, chosen for a large distance between
codewords.  One binary classifier a bit, linear on hashed byte n-grams of the
lower-cased letters, learns to predict it.  A text is decoded by the loss of its
margins against each codeword, each bit weighted by what it got right on texts
held back, and takes the codeword of least loss.  Two codewords with losses
close together make the text ambiguous.

Fitting takes at most `rows_per_language` labelled texts of up to `max_bytes`
bytes.  Scoring reads whole texts, row by row, without a shuffle.

Defined results: a null text and a text without a letter are `und` with score 0;
with one learned language every other text has it; with none, every text is
`und`; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import spans
from chronopanel.llm.sampling import mixed, bounded_sample

BUCKETS = 4096
GRAMS = (1, 2, 3)
#: Everything that is no letter in ASCII counts as a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(128)]


def profiles(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of each text's n-grams by bucket, each n alike."""
    raw, offsets = spans.text_buffer(texts)
    raw, n = _FOLD[raw], len(texts)
    text = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, BUCKETS), np.float32)
    value = np.zeros(len(raw), np.uint32)
    for k in GRAMS:
        # value holds the last k bytes up to each position.
        value = (value << np.uint32(8) | raw)[k > 1 :] if k == 1 else (value[:-1] << np.uint32(8) | raw[k - 1 :]) & np.uint32((1 << 8 * k) - 1)
        own = text[k - 1 :][: len(value)]
        whole = text[: len(value)] == own
        # Runs of blanks carry no language.
        whole &= (value & np.uint32(0xFFFF)) != 0x2020 if k > 1 else value != 32
        bucket = ((value * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64)
        count = np.bincount(own[whole] * BUCKETS + bucket[whole], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out += count / np.maximum(count.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out / len(GRAMS))


def codewords(kinds: int, seed: int = 11) -> np.ndarray:
    """One row of +1 and -1 a language; up to six languages take all distinct splits, more take the best of random codes."""
    if kinds <= 6:
        splits = range(1, 2 ** (kinds - 1))
        return np.array([[1 if k == kinds - 1 or not s >> k & 1 else -1 for s in splits] for k in range(kinds)]).reshape(kinds, -1)
    rng, bits, best, distance = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(kinds))), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (kinds, bits))
        if (abs(code.sum(axis=0)) == kinds).any():
            continue
        product = code @ code.T
        apart = (bits - product[~np.eye(kinds, dtype=bool)].max()) // 2
        if apart > distance:
            best, distance = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each text's margins against each codeword."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        return np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1) / self.trust.sum()

    def predict(self, texts: pa.Array, ambiguous_below: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
        names, score, unsure = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages or not lettered.any():
            return names.tolist(), score, unsure
        if len(self.languages) == 1:
            names[lettered], score[lettered], unsure[lettered] = self.languages[0], 1.0, False
            return names.tolist(), score, unsure
        loss = self.losses(profiles(texts))
        best = loss.argmin(axis=1)
        likely = np.exp(-len(self.trust) * (loss - loss.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        near = np.partition(loss, 1, axis=1)
        names[lettered] = np.array(self.languages, object)[best[lettered]]
        score[lettered] = likely.max(axis=1)[lettered]
        unsure[lettered] = (near[:, 1] - near[:, 0])[lettered] < ambiguous_below
        return names.tolist(), score, unsure


def fit(sample: list[tuple[str, str]], rounds: int = 150, ridge: float = 1e-4) -> Model:
    """Logistic classifiers of all bits at once, by accelerated gradient steps."""
    languages = sorted({v for _, v in sample})
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((1, 0)), np.zeros(0))
    kind = np.array([languages.index(v) for _, v in sample])
    x = np.concatenate([profiles(pa.array([t for t, _ in sample[a : a + 200]], pa.string())) for a in range(0, len(sample), 200)])
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    code = codewords(len(languages))
    held = np.arange(len(x)) % 5 == 4
    y, share = code[kind].astype(np.float32), 1 / np.bincount(kind[~held], minlength=len(languages)).clip(1)

    def solve(rows: np.ndarray) -> np.ndarray:
        a, b, own = x[rows], y[rows], (share[kind[rows]] / len(languages))[:, None].astype(np.float32)
        w = before = np.zeros((x.shape[1], y.shape[1]), np.float32)
        step = 4.0 / float((own * np.square(a).sum(axis=1, keepdims=True)).sum())
        for k in range(1, rounds + 1):
            ahead = w + (k - 1) / (k + 2) * (w - before)
            pull = a.T @ (own * b / (1 + np.exp(np.clip(b * (a @ ahead), -30, 30))))
            before, w = w, ahead + step * (pull - ridge * ahead)
        return w

    w = solve(~held)
    right = (np.sign(x[held] @ w) == y[held]).mean(axis=0) if held.any() else np.ones(y.shape[1])
    return Model(languages, code, w, np.maximum(right - 0.5, 0.02))


def labelled_sample(docs: DataFrame, fold: Column, rows_per_language: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most `rows_per_language` training texts of each language, drawn by a hash of the id."""
    rows = docs.where(fold).where(F.col(text_col).rlike(r"\p{L}"))
    known = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label")).where("label IS NOT NULL")
    return mixed(bounded_sample(rows, known, rows_per_language, max_bytes, id_col, text_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.05) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in spans.chunks(batch, "text"):
                # The profile table has a row a text, so short texts come in bounded numbers too.
                for lo in range(0, len(chunk), 512):
                    part = chunk.slice(lo, 512)
                    names, score, unsure = model.predict(part.column(1), ambiguous_below)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
