"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import stored


def bounded_sample(docs: DataFrame, known: DataFrame, rows_per_class: int, max_bytes: int, id_col: str, text_col: str) -> list[tuple]:
    """(text, label) of at most `rows_per_class` rows of each label in `known` (id, label), among texts of up to `max_bytes`.

    Rows are drawn by a hash of their id, so the sample is the same on every run
    and takes bounded memory.  The draw sees ids and lengths only; texts are then
    fetched by the drawn ids, whose number is bounded, so no text is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = rows.where(F.octet_length("text") <= max_bytes).select("id").join(known, "id").distinct()
    values = sorted(r[0] for r in known.select("label").distinct().collect())
    drawn = None
    for value in values:
        own = sizes.where(F.col("label") == F.lit(value)).orderBy(F.xxhash64("id"), "id").limit(rows_per_class)
        drawn = own if drawn is None else drawn.union(own)
    if drawn is None:
        return []
    chosen = stored(drawn, "sample-ids")
    # At most rows_per_class ids of each label: a proven bound.
    texts = rows.join(F.broadcast(chosen), "id").where(F.octet_length("text") <= max_bytes)
    first = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    return sorted(((r.text, r.label) for r in first.collect()), key=lambda x: (x[1], x[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, rows_per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most `rows_per_class` training rows of either label in the table `labels`; null texts count as empty."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    return mixed(bounded_sample(docs.where(fold), known, rows_per_class, max_bytes, id_col, text_col))


def mixed(sample: list[tuple]) -> list[tuple]:
    """The labels in turn, so that every third or fifth row is a fair share to hold back."""
    by_label: dict = {}
    for text, label in sample:
        by_label.setdefault(label, []).append((text, label))
    turns = [((k + 0.5) / len(rows), row) for rows in by_label.values() for k, row in enumerate(rows)]
    return [row for _, row in sorted(turns)]
