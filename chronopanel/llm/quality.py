"""Quality from compression: which of two dictionaries makes a text smaller.

Fitting: zstandard dictionaries are trained on pieces of good and of bad texts, a
third held back.  Every text is compressed piece by piece with each of them; the
difference of its two sizes, over their sum, and the sizes per byte are turned
into a probability by a logistic fit on the texts held back.  The sample is
bounded by `rows_per_class` and `max_bytes`.

Scoring reads whole texts, row by row, without a shuffle; the model is two
dictionaries of `dictionary_bytes` and a few numbers.

Defined results: null and empty texts get the score of an empty piece; without
labelled rows of both classes every text scores the share of good rows, 0.5
where there are none; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import spans

PIECE_BYTES = 4096
LEVEL = 3


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes] | None
    weights: np.ndarray

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Compressed bytes of each text with the bad and the good dictionary, and its length."""
        out = np.zeros((len(texts), 3))
        for k, data in enumerate(self.dictionaries):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            one = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False).compress
            for i, text in enumerate(texts):
                out[i, k] = sum(len(one(text[a : a + PIECE_BYTES])) for a in range(0, max(len(text), 1), PIECE_BYTES))
        out[:, 2] = [len(t) for t in texts]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), self.weights[0])
        return 1 / (1 + np.exp(-np.clip(features(self.sizes(texts)) @ self.weights, -30, 30)))


def features(sizes: np.ndarray) -> np.ndarray:
    bad, good, raw = sizes.T
    gap = (bad - good) / (bad + good)
    # The sizes per byte tell where a gap is small because both sizes are.
    dense = np.log((bad + good) / (2 * (raw + 16)))
    return np.stack([np.ones(len(gap)), gap * 10, dense, dense * dense, gap * dense * 10], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic fit; the intercept is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[str, int]], dictionary_bytes: int = 65_536) -> Model:
    texts, labels = [t.encode() for t, _ in sample], np.array([v for _, v in sample], float)
    held = np.arange(len(texts)) % 3 == 2
    parts = [[t[a : a + PIECE_BYTES] for t, v, h in zip(texts, labels, held) if v == k and not h for a in range(0, len(t), PIECE_BYTES)] for k in (0, 1)]
    if min(map(len, parts)) < 8 or len(set(labels[held])) < 2:
        return Model(None, np.array([labels.mean() if len(labels) else 0.5]))
    made = tuple(zstandard.train_dictionary(min(dictionary_bytes, max(1024, sum(map(len, p)) // 8)), p).as_bytes() for p in parts)
    model = Model(made, np.zeros(5))
    model.weights = logistic(features(model.sizes([t for t, h in zip(texts, held) if h])), labels[held])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; predicted is 1 from the threshold on."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                p = model.scores([(t or "").encode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores the threshold or more, with all their columns; null texts count as empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = model.scores([(t or "").encode() for t in batch.column(at).to_pylist()]) >= threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
