"""Line dedup: content-defined chunks of lines find passages that stand elsewhere too.

DataFrame functions only.

1. Every line gets a hash.  Lines whose hash stands once in the corpus end a run of
   recurring lines; runs below `min_chars` characters hold no repeated passage.
2. A polynomial over the line hashes rolls along every run: the hash of any stretch
   of lines is a difference of two running sums.  At every line it is taken of the
   fewest lines from there on, and of the fewest up to there, that have `min_chars`
   characters.  Such a stretch depends on its own lines alone, so text put in before
   or after it moves nothing.
3. A stretch that stands earlier too is repeated.  Chunk boundaries are the lines
   where repeated stretches begin and end; overlapping ones make one chunk.  Each line
   of a run of equal lines of `min_chars` or more is in a stretch inside the run, so no
   repeated passage is missed, wherever its lines stand otherwise.  (Boundaries by a
   bit mask on the hash would miss passages that hold none.)
4. The bytes of all lines with a hash to be removed are compared; a hash that
   stands for two different lines removes nothing.
5. The chunks go, and the earliest copy of every passage stays: by id, then by
   line number.  A line is only removed for an equal line before it in that order.

Lines without characters take part by position only: stretches are sought among the
others, of which `min_chars` bounds the number, so a million blank lines cost a million
rows and no more.  Joins between hashes are on stored tables, so adaptive execution
splits a hot hash; groups are combined before the shuffle; no group is gathered.
Tables in the shared folder are deleted as soon as a later one replaces them.

Defined results: null text stays null; an empty text stays empty; a text whose
lines all go becomes empty, its row stays; rows equal in id and text get equal
results; a null id comes before all others; no rows give no rows; all other
columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.shared import bound, broadcast_within, freed, row_key, stored

#: Primes below 2**31 and bases of the rolling hash: sums of terms and products of two stay below 2**63.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (48271, 69621, 16807, 39373)
#: Line numbers stay below this; a stretch's sum is moved to this power, so equal stretches agree at any place.
TOP = 1 << 31


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _power(base: int, modulus: int, exponent: str) -> str:
    """SQL of base ** exponent modulo a prime, by one table for each byte of the exponent (below 2**32)."""
    out = ""
    for byte in range(4):
        step = pow(base, 1 << (8 * byte), modulus)
        # One text constant, which the optimizer folds to an array.
        table = ",".join(str(pow(step, k, modulus)) for k in range(256))
        part = f"get(cast(split('{table}', ',') AS array<bigint>), cast(shiftright(cast({exponent} AS bigint), {8 * byte}) & 255 AS int))"
        out = f"({out} * {part}) % {modulus}" if out else part
    return out


def _recurring(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, key, i, h, n, run) of the lines in runs of lines that all stand somewhere else too."""
    lines = _lines(F.col("text"))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    hashed = rows.select("id", "key", F.transform(lines, lambda x: F.struct(F.unhex(F.md5(x)).alias("h"), F.length(x).alias("n"))).alias("l"))
    base = stored(hashed.dropDuplicates(["key"]), "lines-base")
    each = base.select("id", "key", F.posexplode("l").alias("i", "l")).select("id", "key", "i", "l.h", "l.n")
    twice = stored(each.groupBy("h").count().where("count > 1").select("h"), "lines-twice")
    found = stored(each.join(broadcast_within(twice), "h", "left_semi"), "lines-found")
    freed(base, twice)
    in_doc = Window.partitionBy("key").orderBy("i")
    numbered = found.withColumn("run", F.col("i") - F.row_number().over(in_doc))
    numbered = numbered.withColumn("all", F.sum(F.col("n").cast("long")).over(Window.partitionBy("key", "run")))
    runs = stored(numbered.where(F.col("all") >= min_chars).drop("all"), "lines-runs")
    freed(found)
    return runs


def _stretches(lines: DataFrame, min_chars: int) -> DataFrame:
    """(id, key, a, b, w): the fewest lines from every line on, and up to it, with `min_chars` characters; w is the hash of their contents."""
    in_run = Window.partitionBy("key", "run")
    hashes = list(enumerate(zip(MODULI, BASES)))
    # Running sums of line hash times base ** line number; lines without characters add nothing, but keep their place.
    terms = [F.expr(f"(pmod(xxhash64(h, {k}), {p}) * ({_power(b, p, 'i')})) % {p} AS t{k}") for k, (p, b) in hashes]
    places = [F.expr(f"{_power(b, p, f'{TOP} - i')} AS q{k}") for k, (p, b) in hashes]
    inked = lines.where("n > 0").select("id", "key", "run", "i", F.col("n").cast("long").alias("n"), *terms, *places)
    so_far = in_run.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inked = inked.select("*", F.sum("n").over(so_far).alias("after"), *[F.sum(f"t{k}").over(so_far).alias(f"s{k}") for k, _ in hashes])
    inked = inked.withColumn("before", F.col("after") - F.col("n"))
    last = F.struct("i", "after", *[f"s{k}" for k, _ in hashes])
    first = F.struct("i", "before", *[f"{x}{k}" for k, _ in hashes for x in "stq"])
    inked = inked.select(
        "*",
        F.last(last).over(in_run.orderBy("before").rangeBetween(0, min_chars - 1)).alias("last"),
        F.first(first).over(in_run.orderBy("after").rangeBetween(1 - min_chars, 0)).alias("first"),
    )

    def content(start: str, end: str) -> Column:
        """Hash of the stretch between two lines, moved to a fixed power."""
        return F.expr("array(" + ", ".join(f"(pmod({end}s{k} - {start}s{k} + {start}t{k}, {p}) * {start}q{k}) % {p}" for k, (p, _) in hashes) + ")")

    forward = F.when(F.col("last.after") - F.col("before") >= min_chars, F.struct(F.col("last.i").alias("to"), content("", "last.").alias("w")))
    backward = F.when(F.col("after") - F.col("first.before") >= min_chars, F.struct(F.col("first.i").alias("to"), content("first.", "").alias("w")))
    inked = inked.select("id", "key", "run", "i", F.struct("i", forward.alias("s")).alias("forward"), F.struct("i", backward.alias("s")).alias("backward"))
    # A line without characters lengthens the stretch of the next line that has some, and of the one before.
    blank = lines.where("n = 0").select("id", "key", "run", "i", *[F.lit(None).cast(inked.schema[c].dataType).alias(c) for c in ("forward", "backward")])
    every = inked.union(blank)
    every = every.withColumn("backward", F.last("backward", ignorenulls=True).over(so_far))
    every = every.withColumn("forward", F.last("forward", ignorenulls=True).over(in_run.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pair = F.array(
        F.struct(F.col("i").alias("a"), F.col("forward.s.to").alias("b"), F.col("forward.s.w").alias("w"), (F.col("forward.i") - F.col("i")).alias("gap")),
        F.struct(F.col("backward.s.to").alias("a"), F.col("i").alias("b"), F.col("backward.s.w").alias("w"), (F.col("backward.i") - F.col("i")).alias("gap")),
    )
    found = every.select("id", "key", F.explode(pair).alias("x")).where("x.w IS NOT NULL")
    return found.select("id", "key", "x.a", "x.b", F.md5(F.concat_ws(",", F.col("x.w").cast("array<string>"), F.col("x.gap").cast("string"))).alias("w"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """(key, line): the lines, from 0, that stand in a repeated passage and are not its first copy."""
    lines = _recurring(docs, id_col, text_col, min_chars)
    found = stored(_stretches(lines, min_chars), "lines-stretches")
    firsts = found.groupBy("w").agg(F.min(F.struct("id", "key", "a")).alias("f"), F.count(F.lit(1)).alias("copies"))
    firsts = stored(firsts.where("copies > 1").select("w", F.col("f.key").alias("from_key"), F.col("f.a").alias("from_a")), "lines-firsts")
    later = found.join(firsts, "w").where((F.col("key") != F.col("from_key")) | (F.col("a") != F.col("from_a"))).select("key", "a", "b")
    # Stretches that overlap or touch make one chunk.
    in_doc = Window.partitionBy("key").orderBy("a", "b")
    later = later.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)))
    later = later.withColumn("chunk", F.sum(F.col("new").cast("int")).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = later.groupBy("key", "chunk").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = chunks.select("key", F.explode(F.sequence("a", "b")).alias("line"))
    gone = stored(gone.join(lines.select("key", F.col("i").alias("line"), F.lower(F.hex("h")).alias("hash")), ["key", "line"]), "lines-gone")
    freed(lines, found, firsts)
    bad = stored(_ambiguous(docs, text_col, gone), "lines-ambiguous")
    return gone.join(broadcast_within(bad), "hash", "left_anti").select("key", "line")


def _ambiguous(docs: DataFrame, text_col: str, gone: DataFrame) -> DataFrame:
    """Hashes among those of `gone` that stand for lines with different bytes."""
    asked = broadcast_within(stored(gone.select("hash").distinct(), "lines-asked"))
    lines = docs.select(F.explode(_lines(F.col(text_col))).alias("line")).select(F.md5("line").alias("hash"), "line")
    return lines.join(asked, "hash", "left_semi").distinct().groupBy("hash").count().where("count > 1").select("hash")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """All rows and columns, repeated lines taken out of the text; n_lines and n_removed are added, or replaced."""
    gone = repeated_lines(docs, id_col, text_col, min_chars)
    # Runs of removed lines: line number minus rank is constant inside a run.
    per_doc = gone.groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    # The list is no longer than its document.
    ends = F.filter("gone", lambda x, i: F.coalesce(F.get("gone", i + 1) != x + 1, F.lit(True)))
    begins = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", F.greatest(i - 1, F.lit(0))) != x - 1))
    per_doc = per_doc.select(F.col("key").alias("__key"), F.size("gone").cast("long").alias("__removed"), F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)).alias("__a"), begins.alias("__b"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    lines = _lines(F.col(text_col))

    def rest(own: Column) -> Column:
        ranges = F.arrays_zip(F.col("__a").alias("a"), F.concat("__b", F.array(F.size(own))).alias("b"))
        return F.array_join(F.flatten(F.transform(ranges, lambda r: F.slice(own, r["a"] + 1, r["b"] - r["a"]))), "\n")

    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(bound(lines, rest))
    joined = keyed.join(per_doc, "__key", "left")
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("__removed", F.lit(0)).cast("long").alias("n_removed"),
    )
