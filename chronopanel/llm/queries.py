"""Registered queries of the corpus operators: thin digests of the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import bpe, conversation, decontaminate, langid, licenses, line_dedup, lm_score, phrases, quality, repetition, simhash, token_store, toxicity
from chronopanel.llm.sampling import labelled_sample
from chronopanel.llm.shared import shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    coded = bpe.encode(_documents(spark, sf_dir), with_text=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def _remainder(of: int):
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the repeated passages, and how many of its lines went."""
    return line_dedup.dedup(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned outside the fold; at most 1000 labelled rows of up to 6000 bytes of either class."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", _remainder(5) != 0, 1000, 6000))
    return toxicity.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: 0.8 or more of its five-word shingles."""
    return decontaminate.contained(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned outside the fold; at most 400 rows of up to 20000 bytes of each language."""
    docs = _documents(spark, sf_dir)
    model = langid.fit(langid.labelled_sample(docs, _remainder(4) != 2, 400, 20_000))
    return langid.identify(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact unigram base and bigram-model score of every text, learned outside the fold."""
    scored = lm_score.score(_documents(spark, sf_dir), _remainder(5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned outside the fold; at most 1500 labelled rows of up to 65536 bytes of either class."""
    return quality.fit(labelled_sample(docs, labels, "quality", _remainder(5) != 0, 1500, 65_536))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text."""
    docs = _documents(spark, sf_dir)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and the smallest document of its component."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, read back through the index."""
    docs = _documents(spark, sf_dir)
    path = token_store.write(docs, shared_path(spark, "token-store"))
    back = token_store.read(spark, path, docs, "doc_id")
    return back.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("payload").alias("ids_crc32"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the verdict of the repetition rules."""
    return repetition.rules(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language by their weakest cut."""
    return phrases.mine(_documents(spark, sf_dir))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every text."""
    docs = _documents(spark, sf_dir)
    return licenses.scan(docs, licenses.fit(docs))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, cheapest edits and a digest of every repaired conversation, after the damage that the contract names."""
    rows = conversation.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation.report(rows, present=F.col("present")).withColumnRenamed("conv", "conv_id")


#: Words, windows of 8, 5 and 51 words found twice or more, and lines, as the rules state them.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT doc_id, k, i, list_slice(ws, i, i + k - 1) AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM w, (VALUES (8), (5), (51)) AS sizes(k) WHERE len(ws) >= k)
),
twice AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM twice) GROUP BY doc_id, k),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c8.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(c5.n, 0) AS n5, coalesce(c51.n, 0) AS n51
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN cov AS c8 ON w.doc_id = c8.doc_id AND c8.k = 8
  LEFT JOIN cov AS c5 ON w.doc_id = c5.doc_id AND c5.k = 5 LEFT JOIN cov AS c51 ON w.doc_id = c51.doc_id AND c51.k = 51
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n5 <= 3 * n_words AND n51 = 0 AS kept
FROM f
"""

#: The rule itself: longest runs of equal lines at any two places, and of 200 characters or more; the later run goes.
OP2_SQL = """
WITH l AS (
  SELECT doc_id, i, line, length(line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)
),
same AS (
  SELECT a.doc_id, b.doc_id AS from_id, a.i - b.i AS shift, a.i, a.n,
    a.i - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.i - b.i ORDER BY a.i) AS island
  FROM l AS a JOIN l AS b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))
),
runs AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, from_id, shift, island) AS chars FROM same),
gone AS (SELECT DISTINCT doc_id, i FROM runs WHERE chars >= 200),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents AS d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: All shingles against all items' shingles, without the search.
OP4_SQL = r"""
WITH iw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
ish AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s FROM (SELECT item_id, ws, least(len(ws), 5) AS k, unnest(range(1, CAST(greatest(len(ws) - 4, 1) + 1 AS BIGINT))) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT least(len(ws), 5) AS k FROM iw WHERE len(ws) > 0),
dsh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM dw, sizes WHERE len(ws) >= k)),
size AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS c FROM dsh JOIN ish ON dsh.s = ish.s GROUP BY doc_id, item_id)
SELECT doc_id, hits.item_id, CAST(n AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS n_shared, CAST(c AS DOUBLE) / n AS containment
FROM hits JOIN size ON hits.item_id = size.item_id WHERE c >= 0.8 * n - 1e-9
"""

#: All phrases of one to four words, all cuts, all longer phrases, in 128-bit whole numbers.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
f AS (
  SELECT lang, k, s, CAST(count(*) AS HUGEINT) AS c
  FROM (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s FROM (SELECT lang, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(ws) >= k))
  GROUP BY lang, k, s
),
totals AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, s, c FROM f WHERE c >= 30),
candidates AS MATERIALIZED (SELECT lang, k, s, c AS a, string_split(s, ' ') AS p FROM f WHERE k > 1 AND c >= 30),
cuts AS (
  SELECT lang, s, a, j, array_to_string(p[1:j], ' ') AS head, array_to_string(p[j + 1:], ' ') AS tail
  FROM candidates, (VALUES (1), (2), (3)) AS places(j) WHERE j < k
),
best AS (
  SELECT x.lang, x.s, x.a, min({'score': 2000000 * x.a // (h.c + t.c), 'j': j, 'l': h.c, 'r': t.c}) AS b
  FROM cuts AS x JOIN frequent AS h ON h.lang = x.lang AND h.s = x.head JOIN frequent AS t ON t.lang = x.lang AND t.s = x.tail
  GROUP BY x.lang, x.s, x.a
),
inside AS (
  SELECT lang, s, max(a) AS g FROM (
    SELECT lang, a, array_to_string(p[i:i + m - 1], ' ') AS s
    FROM candidates, (VALUES (3, 2, 1), (3, 2, 2), (4, 2, 1), (4, 2, 2), (4, 2, 3), (4, 3, 1), (4, 3, 2)) AS parts(n, m, i) WHERE n = k
  ) GROUP BY lang, s
),
ranked AS (
  SELECT best.lang, best.s AS phrase, a, b, row_number() OVER (PARTITION BY best.lang ORDER BY b.score DESC, a DESC, encode(best.s)) AS rank
  FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.s = best.s WHERE g IS NULL OR 100 * g < 80 * a
)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(b.l AS BIGINT) AS l, CAST(b.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(b.score AS BIGINT) AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

#: CRC-32 by its polynomial, faults by windows, and all edits row by row: of each state the cheapest, then least, remains.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda k: CAST(ascii(substr(name, CAST(k AS BIGINT), 1)) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS how
  FROM named, crc
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE how <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || role[1] AS pair
  FROM hurt
),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM numbered
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM faulty GROUP BY conv_id
),
nexts AS (SELECT * FROM (VALUES ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) AS t(st, nx)),
inserts AS (SELECT st, '' AS pre, 0 AS paid, st AS mid, '' AS made FROM nexts UNION ALL SELECT st, 'I', 3, nx, nx FROM nexts),
moves AS (
  SELECT st, NULL AS initial, 'D' AS edit, 4 AS cost, st AS st2, '' AS made, NULL AS as_role FROM nexts
  UNION ALL SELECT i.st, NULL, pre || 'R', paid + 3, nx, made, nx FROM inserts AS i JOIN nexts AS n ON n.st = i.mid
  UNION ALL SELECT i.st, nx, pre || 'K', paid, nx, made, NULL FROM inserts AS i JOIN nexts AS n ON n.st = i.mid
  UNION ALL SELECT '-', 's', 'K', 0, 's', '', NULL
),
search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, '-' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS made FROM counts
  UNION ALL
  SELECT conv_id, k, st, x.cost, x.audit, x.made FROM (
    SELECT f.conv_id, f.k, m.st2 AS st, min({'cost': s.cost + m.cost + CASE WHEN fault = 't' AND edit <> 'D' THEN 3 ELSE 0 END, 'audit': audit || edit,
      'made': s.made || CASE m.made WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END
        || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || coalesce(CASE as_role WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' END, role) || ':' || text END}) AS x
    FROM search AS s JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k + 1
    JOIN moves AS m ON m.st = s.st AND (m.initial IS NULL OR m.initial = role[1]) AND (edit = 'D' OR fault NOT IN ('b', 'd'))
    GROUP BY f.conv_id, f.k, m.st2
  )
),
ends AS (SELECT * FROM (VALUES ('-', '', 0, ''), ('a', '', 0, ''), ('u', 'I', 3, chr(10) || 'assistant:'), ('s', 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')) AS t(st, edit, cost, made)),
best AS (
  SELECT s.conv_id, min({'cost': s.cost + e.cost, 'audit': audit || edit, 'made': s.made || e.made}) AS x
  FROM search AS s JOIN ends AS e ON s.st = e.st JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.k GROUP BY s.conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.cost, 0) AS BIGINT) AS cost,
  coalesce(x.audit, '') AS audit, sha256(coalesce(x.made[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""

QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_line_dedup, op3_toxicity, op4_decontamination, op5_langid, op6_lm_score, op7_quality, op8_simhash, op9_token_store, op10_repetition, op11_collocations, op12_licenses, op13_conversation_repair)
}
ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op10_repetition": OP10_SQL, "op11_collocations": OP11_SQL, "op13_conversation_repair": OP13_SQL}
