"""Benchmark decontamination: size-partitioned MinHash containment search.

DataFrame functions only.

An item of n distinct shingles lies in a document to the share C if a random
shingle of the item is the document's with probability C; its smallest hashes
are such a random draw, whatever the document's size.  Items are partitioned by
size, and each partition draws as many smallest hashes as its largest item
needs: with more than (1 - threshold) * n of them, no document with containment
of the threshold or more can miss all.  So the search has no false negatives,
and a document is asked only whether it holds a drawn shingle.  Candidates are
verified by exact containment of the shingles' texts.

The item side is a table of drawn hashes.  It is broadcast behind a check of its
size and joined by a shuffle beyond it; document shingles are hashes made in the
scan.  Candidates are distinct (document, item) pairs, and only candidate
documents' texts are read again.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; an item of
fewer words than a shingle counts as one shorter shingle, and documents are hashed at
the lengths of such items too; an item without words is never found; null texts hold
nothing; `contained` does not search rows without an id, `clean` judges every row by id
and text; repeated rows of a document give one result; repeated items each give theirs;
an empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import bound, broadcast_within, row_key, stored

#: Items' shingle counts grow by this factor from one size partition to the next.
SIZE_STEP = 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BLANK), lambda w: w != "")


def _starts(w: Column, size: int) -> Column:
    """First word of every shingle of `size` words, from 0."""
    none = F.array().cast("array<int>")
    return F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(none)


def shingle_hashes(w: Column, sizes: list[int]) -> Column:
    """One hash per shingle of any of the sizes."""

    def of(k: int) -> Column:
        return F.transform(_starts(w, k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    return F.flatten(F.array(*[of(k) for k in sizes]))


def shingle_texts(w: Column, size: Column, shingle: int) -> Column:
    """The distinct shingles of `size` words, 1 to `shingle` of them."""
    none = F.array().cast("array<string>")
    starts = F.when((size > 0) & (F.size(w) >= size), F.sequence(F.lit(0), F.size(w) - size))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.least(size, F.lit(shingle))), " "))), none)


def sketches(items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(item, h): the drawn hashes of every item of columns item, w."""
    own = items.where("size(w) > 0")
    short = [own.where(F.size("w") == k).select("item", F.array(F.xxhash64(*[F.get("w", F.lit(j)) for j in range(k)])).alias("all")) for k in range(1, shingle)]
    hashed = own.where(F.size("w") >= shingle).select("item", F.array_distinct(bound(F.col("w"), lambda w: shingle_hashes(w, [shingle]))).alias("all"))
    for table in short:
        hashed = hashed.union(table)
    part = F.ceil(F.log(SIZE_STEP, F.size("all").cast("double")) - F.lit(1e-9))
    largest = F.floor(F.pow(F.lit(SIZE_STEP), part) + 1e-9)
    draw = (F.floor((1 - threshold) * largest + 1e-9) + 1).cast("int")
    # A second hash orders the shingles, so that the draw is a MinHash and not tied to the join key's bits.
    ordered = F.sort_array(F.transform("all", lambda h: F.struct(F.xxhash64(h).alias("o"), h.alias("h"))))
    return hashed.select("item", F.explode(F.slice(ordered, 1, draw)).alias("x")).select("item", "x.h")


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document that holds an item to the threshold."""
    items = stored(benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).select("item", "w", F.xxhash64("item", F.array_join("w", " ")).alias("number")), "leak-items")
    # Items are told apart by id and text; equal ones are searched once and come back at the end.
    drawn = stored(sketches(items.select(F.col("number").alias("item"), "w").distinct(), threshold, shingle), "leak-sketches")
    asked = broadcast_within(drawn)
    # At most `shingle` numbers.
    sizes = sorted(r[0] for r in items.where("size(w) > 0").select(F.least(F.size("w"), F.lit(shingle))).distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    probes = rows.select("doc_id", F.explode(bound(words(F.col("text")), lambda w: shingle_hashes(w, sizes or [shingle]))).alias("h"))
    candidates = stored(probes.join(asked, "h").select("doc_id", F.col("item").alias("number")).distinct(), "leak-candidates")
    found = broadcast_within(candidates.select(F.col("doc_id").alias("id"), "number"))
    texts = rows.join(found, F.col("doc_id") == F.col("id")).select("doc_id", "number", "text")
    size = F.least(F.size("w"), F.lit(shingle))
    own = items.select("number", size.alias("size"), bound(F.col("w"), lambda w: shingle_texts(w, size, shingle)).alias("parts")).distinct()
    own_parts = bound(words(F.col("text")), lambda w: shingle_texts(w, F.col("size"), shingle))
    shared = F.size(F.array_intersect(own_parts, F.col("parts")))
    checked = texts.join(own, "number").select("doc_id", "number", F.size("parts").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    kept = checked.where(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9)
    # Rows with the same id count as one document: its best row.
    best = kept.groupBy("doc_id", "number").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
    named = best.join(items.select("item", "number"), "number")
    return named.select("doc_id", F.col("item").alias("item_id"), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of documents that hold no benchmark item, with all their columns."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    bad = contained(keyed, benchmark, "key", "text", item_col, item_text_col, threshold, shingle).select(F.col("doc_id").alias("__bad")).distinct()
    bad = stored(bad, "leak-documents")
    return docs.join(broadcast_within(bad), row_key(id_col, text_col) == F.col("__bad"), "left_anti")
