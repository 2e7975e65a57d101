"""Phrase collocation mining: n-grams counted in quotient filters, scored by their weakest cut.

1. Words are counted per language; those seen `min_count` times or more get a dense id.
   No phrase with a rarer word can be frequent.
2. Texts become runs of ids, cut at the ends of pieces and at rarer words, and are
   stored once.
3. Every task packs its two-word phrases and counts them in a counting quotient filter;
   the filter is cut by the leading bits of the quotient into shards, and each shard's
   sorted filters are merged.  Longer phrases are counted the same way where all their
   pairs may be frequent.
4. Scores, contained phrases and the best of each language are joins of the frequent
   phrases with one another, in whole numbers of up to 38 digits.

Memory: a shard has a proven bound, as there are no more phrases than words and the
permutation spreads them evenly; a hot phrase is one entry of each filter.  Frequent
pairs are told by a Bloom filter of at most `PAIR_BITS` bits: when it fills, more phrases
are counted in vain, and none is missed.  The dictionary is broadcast within
`dictionary_rows`; beyond, each document's own words meet it in a shuffle.

Defined results: null text counts as empty, null language as `und`; empty texts have
no words; repeated rows count as often as they stand; ties in rank follow the phrase in
UTF-8 bytes; other columns are not read; no frequent phrase gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm import quotient, spans
from chronopanel.llm.shared import freed, row_key, stored

#: Fixed values of the separators: pieces end at these, words at blanks too.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
#: Words of the dictionary that may be broadcast, at some 60 bytes each.
DICTIONARY_ROWS = 1_000_000
#: Expected phrases of a shard, and phrases held by a task before they are counted.
SHARD_KEYS = HELD_KEYS = 1_000_000
PAIR_BITS = 1 << 26
#: Buckets in which words are numbered.
BUCKETS = 256
CHUNK = 4 << 20

_END = np.zeros(256, bool)
_END[list(PIECE_ENDS)] = True
_BETWEEN = _END.copy()
_BETWEEN[list(BLANKS)] = True


def _rows(docs: DataFrame, lang_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def _split(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, each text's first word."""
    raw, offsets = spans.text_buffer(part.column(part.schema.get_field_index("text")))
    raw = spans.lowered(raw)
    return raw, *spans.word_spans(raw, offsets, _BETWEEN)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, f) of all words; counted in the tasks before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text", CHUNK):
                raw, starts, ends, first = _split(part)
                if not len(starts):
                    continue
                langs = part.column(0).dictionary_encode()
                model, code = spans.distinct_spans(raw, starts, ends)
                lang = np.repeat(langs.indices.to_numpy(), np.diff(first)).astype(np.int64)
                kinds, counts = np.unique(lang * len(model) + code, return_counts=True)
                at = model[kinds % len(model)]
                words = pa.array(spans.span_texts(raw, starts[at], ends[at]), pa.binary()).cast(pa.string())
                names = langs.dictionary.take(pa.array(kinds // len(model)))
                yield pa.RecordBatch.from_arrays([names, words, pa.array(counts.astype(np.int64))], ["lang", "word", "f"])

    partial = _rows(docs, lang_col, text_col).mapInArrow(run, "lang string, word string, f bigint")
    return partial.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _numbered(frequent: DataFrame) -> DataFrame:
    """(id, lang, word, f): dense ids from 1, from counts of hash buckets, so no task sees all words."""
    placed = frequent.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)).cast("int"))
    sizes = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}
    before, start = 0, []
    for b in range(BUCKETS):
        start.append(before)
        before += sizes.get(b, 0)
    at = F.get(F.split(F.lit(",".join(map(str, start))), ",").cast("array<bigint>"), F.col("bucket"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return placed.select((at + rank).alias("id"), "lang", "word", "f")


def _runs(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ids with one zero between runs; runs of one id, which make no phrase, are left out.

    `begins` marks words that begin a piece; id 0 is a word that is not frequent.
    """
    linked = np.zeros(len(ids) + 1, bool)
    linked[1:-1] = (ids[1:] > 0) & (ids[:-1] > 0) & ~begins[1:]
    kept = linked[:-1] | linked[1:]
    ids, opens = ids[kept], ~linked[:-1][kept]
    out = np.zeros(len(ids) + int(opens.sum()), np.int64)
    out[np.arange(len(ids)) + np.cumsum(opens)] = ids
    return out


def _begins(raw: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(_END[raw])])[starts]
    begins = np.append(True, ends[1:] != ends[:-1]) if len(starts) else np.zeros(0, bool)
    begins[first[:-1][first[:-1] < len(starts)]] = True
    return begins


def _coded_by_broadcast(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    table = dictionary.select("lang", "word", "id").toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    names = {name: k for k, name in enumerate(langs.dictionary.to_pylist())}
    words = table.column("word").cast(pa.binary()).to_pylist()
    lexicon = spans.Lexicon(words, langs.indices.to_numpy().astype(np.int64))
    shared = spark.sparkContext.broadcast((names, lexicon, np.append(table.column("id").to_numpy(), 0)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lexicon, numbers = shared.value
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                raw, starts, ends, first = _split(part)
                own = np.array([names.get(x, -1) for x in part.column(0).to_pylist()], np.int64)
                # The number of an unknown word, at -1, is zero.
                ids = numbers[lexicon.find(raw, starts, ends, np.repeat(own, np.diff(first)))]
                yield pa.RecordBatch.from_arrays([pa.array([_runs(ids, _begins(raw, starts, first)).astype("<u4").tobytes()], pa.binary())], ["ids"])

    return rows.select("lang", "text").mapInArrow(run, "ids binary")


def _coded_by_shuffle(docs: DataFrame, dictionary: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Each document's distinct words meet the dictionary in a join and come back to it."""
    rows = _rows(docs, lang_col, text_col, row_key(lang_col, text_col).alias("key"))

    def own_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                raw, starts, ends, first = _split(part)
                if not len(starts):
                    continue
                model, code = spans.distinct_spans(raw, starts, ends)
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                kinds = np.unique(doc * len(model) + code)
                at = model[kinds % len(model)]
                words = pa.array(spans.span_texts(raw, starts[at], ends[at]), pa.binary()).cast(pa.string())
                back = pa.array(kinds // len(model))
                yield pa.RecordBatch.from_arrays([part.column(2).take(back), part.column(0).take(back), words], ["key", "lang", "word"])

    each = rows.mapInArrow(own_words, "key string, lang string, word string").distinct()
    known = each.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("key").agg(F.collect_list("word").alias("words"), F.collect_list("id").alias("numbers"))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                raw, starts, ends, first = _split(row)
                words, numbers = row.column(1)[0].as_py() or [], row.column(2)[0].as_py() or []
                ids = np.array([*numbers, 0], np.int64)[spans.Lexicon([w.encode() for w in words]).find(raw, starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([_runs(ids, _begins(raw, starts, first)).astype("<u4").tobytes()], pa.binary())], ["ids"])

    return rows.join(known, "key", "left").select("text", "words", "numbers").mapInArrow(code, "ids binary")


def pair_places(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the Bloom filter of `size` bits for every pair of ids."""
    h = spans.mixed(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
    return h & np.uint64(size - 1), h >> np.uint64(32) & np.uint64(size - 1)


def pair_filter(pairs: DataFrame, n_pairs: int) -> np.ndarray:
    """Bits of all frequent pairs, 64 a number: two set bits a pair in at most PAIR_BITS bits."""
    size = min(PAIR_BITS, max(64, 1 << (16 * n_pairs).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(pair_places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size))
            bits = np.uint64(1) << (places & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])

    found = pairs.select(F.get("ids", F.lit(0)).alias("a"), F.get("ids", F.lit(1)).alias("b")).mapInArrow(run, "at bigint, bits bigint")
    # At most size / 64 rows.
    table = found.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _may_be_frequent(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    seen = np.ones(len(a), bool)
    for place in pair_places(a, b, 64 * len(bits)):
        seen &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return seen


def count_phrases(coded: DataFrame, sizes: tuple[int, ...], bits: int, n_words: int, min_count: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(ids, f) of the phrases of these sizes that stand `min_count` times or more."""
    spark = coded.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard_bits = max(parts - 1, n_words // SHARD_KEYS).bit_length()
    shared = spark.sparkContext.broadcast(pairs)

    def filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: [] for n in sizes}
        for batch in batches:
            for data in batch.column(0):
                ids = np.frombuffer(data.as_buffer(), "<u4")
                for n, keys in _phrases(ids, sizes, shared.value):
                    hi, lo = quotient.permuted(*quotient.packed(keys, bits), quotient.half_bits(bits, n))
                    held[n].append((hi, lo, np.ones(len(hi), np.int64)))
                    if sum(len(x[0]) for x in held[n]) > HELD_KEYS:
                        held[n] = [_together(held[n], quotient.half_bits(bits, n))]
                        if len(held[n][0][0]) > HELD_KEYS // 2:
                            yield from _shards(n, held[n].pop())
        for n in sizes:
            if held[n]:
                yield from _shards(n, _together(held[n], quotient.half_bits(bits, n)))

    def _shards(n: int, entries: tuple) -> Iterator[pa.RecordBatch]:
        """One filter for every shard that has entries."""
        hi, lo, counts = entries
        h = quotient.half_bits(bits, n)
        own = min(shard_bits, h)
        shard = hi >> np.uint64(h - own)
        edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(hi) else []
        for a, b in zip(edge, [*edge[1:], len(hi)]):
            data = quotient.to_filter(hi[a:b], lo[a:b], counts[a:b], h, own, int(shard[a]))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([int(shard[a])], pa.int64()), pa.array([data], pa.binary())], ["n", "shard", "filter"])

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for n, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (n, shard) != now:
                    if held:
                        yield frequent(now[0], held)
                    now, held = (n, shard), []
                held.append(quotient.from_filter(data.as_buffer().to_pybytes())[:3])
                if sum(len(x[0]) for x in held[1:]) > HELD_KEYS:
                    held = [_together(held, quotient.half_bits(bits, n))]
        if held:
            yield frequent(now[0], held)

    def frequent(n: int, held: list[tuple]) -> pa.RecordBatch:
        h = quotient.half_bits(bits, n)
        hi, lo, counts = _together(held, h)
        keep = counts >= min_count
        ids = np.stack(quotient.unpacked(*quotient.restored(hi[keep], lo[keep], h), bits, n), axis=1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, n, dtype=np.int32)), pa.array(ids.reshape(-1)))
        return pa.RecordBatch.from_arrays([lists, pa.array(counts[keep])], ["ids", "f"])

    sent = coded.mapInArrow(filters, "n int, shard bigint, filter binary")
    dealt = sent.repartition(parts, "n", "shard").sortWithinPartitions("n", "shard")
    return dealt.mapInArrow(merged, "ids array<bigint>, f bigint")


def _together(pieces: list[tuple], h: int) -> tuple:
    return quotient.counted(*(np.concatenate(x) for x in zip(*pieces)), h)


def _phrases(ids: np.ndarray, sizes: tuple[int, ...], pairs: np.ndarray | None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns of word ids of all phrases of each size whose pairs may all be frequent."""
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if len(ids) > 1 else np.zeros(0, np.int64)
    if pairs is not None:
        both = both[_may_be_frequent(ids[both], ids[both + 1], pairs)]
    begins = np.zeros(len(ids) + 3, bool)
    begins[both] = True
    for n in sizes:
        at = both
        for k in range(1, n - 1):
            at = at[begins[at + k]]
        if len(at):
            yield n, [ids[at + k] for k in range(n)]


def _big(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) by the lowest-scoring cut, of equal ones the earliest."""
    cut = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("*", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, 4)").alias("tail"))
    found = cut.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    # The product has up to 27 digits, the result at most 1000000.
    whole = F.expr("(cast(2000000 AS decimal(8,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    found = found.withColumn("score", whole.cast("long"))
    best = found.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("ids", "a", "x.l", "x.r", "x.score")


def contained(phrases: DataFrame, percent: int) -> DataFrame:
    """(ids): phrases inside a longer one that has `percent` of their count."""
    inside = "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))"
    longer = phrases.where(F.size("ids") > 2).select(F.explode(F.expr(inside)).alias("ids"), F.col("f").alias("g"))
    most = longer.groupBy("ids").agg(F.max("g").alias("g"))
    return phrases.join(most, "ids").where(_big("g") * 100 >= _big("f") * percent).select("ids")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 30, percent: int = 80, top: int = 2000, dictionary_rows: int = DICTIONARY_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of every language."""
    spark = docs.sparkSession
    words = stored(word_counts(docs, lang_col, text_col), "phrase-words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").cast("long").alias("n")), "phrase-totals")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    dictionary = stored(_numbered(words.where(F.col("f") >= min_count)), "phrase-dictionary")
    freed(words)
    n_ids = dictionary.count()
    bits = max(2, n_ids.bit_length() + n_ids.bit_length() % 2)
    if n_ids <= dictionary_rows:
        coded = _coded_by_broadcast(_rows(docs, lang_col, text_col), dictionary)
    else:
        coded = _coded_by_shuffle(docs, dictionary, lang_col, text_col)
    coded = stored(coded, "phrase-ids")
    pairs = stored(count_phrases(coded, (2,), bits, n_words, min_count), "phrase-pairs")
    told = pair_filter(pairs, pairs.count())
    longer = stored(count_phrases(coded, (3, 4), bits, n_words, min_count, told), "phrase-longer")
    freed(coded)
    phrases = pairs.union(longer)
    counts = phrases.union(dictionary.select(F.array("id").alias("ids"), "f"))
    kept = scored(phrases, counts).join(contained(phrases, percent), "ids", "left_anti")
    kept = kept.withColumn("id", F.get("ids", F.lit(0))).join(dictionary.select("id", "lang"), "id").drop("id")
    # The best of parts of a language first, so that no task ranks a whole language.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    kept = kept.withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    kept = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
    kept = stored(kept, "phrase-best")
    each = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(dictionary.select("id", "word"), "id")
    named = each.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = kept.join(named, "ids").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
