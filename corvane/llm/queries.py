"""The queries of the training-data operators, and SQL for those that SQL can express.

op1, op2, op3 (checksums), op5, op8, op9 and op10 have no SQL: tests/llm compares them with brute
force, exact round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, languages, licenses, mixing, near_duplicates, quotations, sharding, tokens, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and covered spans (label:first-end, comma-joined); see licenses.scan_licenses."""
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    span = lambda s: F.concat(s["label"], F.lit(":"), s["first_word"], F.lit("-"), s["end_word"])
    return found.withColumn("spans", F.array_join(F.transform("spans", span), ","))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and predictions of all documents; see toxicity.train and toxicity.score."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; see sharding.shard_documents."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; see mixing.mix (the words by shard are the operator's, SQL has none)."""
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("shard_words", "row_key", "source")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(concat_ws(':', '{mixing.SEED}', doc_id::VARCHAR, md5(text))) AS ord
  FROM documents),
s0 AS (SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS i FROM s0),
s2 AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(s) OVER () AS t FROM s1),
s3 AS (SELECT *, coalesce(sum(s) OVER p, 0) AS sb, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS wl FROM s2
       WINDOW p AS (ORDER BY s::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT (1.5::DOUBLE * t::DOUBLE - 2 * sb::DOUBLE) / wl AS level FROM s3 WHERE (3 * t - 4 * sb) * w <= 4 * s * wl
       ORDER BY s::DOUBLE / w, i LIMIT 1),
s4 AS (SELECT source, i, s, t, least(2 * s::DOUBLE, w * level) AS target, (s + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS n FROM s2, lv),
qu AS (SELECT i, target / (2 * k + 1) AS q FROM s4, LATERAL (SELECT unnest(range(0, (2 * n)::BIGINT)) AS k) r),
rk AS (SELECT i, row_number() OVER (ORDER BY q DESC, i) AS r FROM qu),
st AS (SELECT i, count(*) AS got FROM rk
       WHERE r <= (SELECT (6 * max(t) + 2 * {mixing.BLOCK}) // (4 * {mixing.BLOCK}) FROM s4) GROUP BY i),
s5 AS (SELECT s4.*, coalesce(got, 0) // greatest(n, 1) AS rounds, coalesce(got, 0) % greatest(n, 1) AS extra,
              CASE WHEN n > 1 THEN {mixing.PRIMES[0]} % n ELSE 0 END AS step, (({mixing.SEED} + s4.i) * 2654435761) % greatest(n, 1) AS start
       FROM s4 LEFT JOIN st ON st.i = s4.i),
ln AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM d),
bl AS (SELECT ln.*, s5.s, s5.target, s5.rounds,
              CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range(f // {mixing.BLOCK}, (f + size - 1) // {mixing.BLOCK} + 1),
                lambda b: CASE WHEN (step * b + start) % n < extra THEN least(f + size, (b + 1) * {mixing.BLOCK}) - greatest(f, b * {mixing.BLOCK}) ELSE 0 END)) END AS more
       FROM ln JOIN s5 ON ln.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, (rounds * size + more)::BIGINT AS taken FROM bl
"""


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with what they quote, in reply order; see quotations.link_quotations."""
    return quotations.link_quotations(_read(spark, sf_dir, "conversations"))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; see languages.train and languages.identify."""
    return languages.languages(_read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates at 85 %; see near_duplicates.near_duplicates."""
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items by the documents that hold them; see decontamination.contaminated."""
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components at cosine 0.93; see embeddings.embedding_duplicates."""
    return embeddings.embedding_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written and read back; see tokens.write_tokens and tokens.read_tokens."""
    return tokens.token_table(_read(spark, sf_dir, "documents"), TOKENIZER)


_BLANK = "[\\x20\\x09-\\x0D]"
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH h AS (SELECT row_number() OVER () AS b, item_id, text, regexp_extract(regexp_replace(text, '{_BLANK}+$', ''), '(?s)^(.*[.!?]){_BLANK}.*$', 1) AS q
       FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
b AS (SELECT b, item_id, {_WORDS.format("text")} AS w, {_WORDS.format("CASE WHEN q = '' THEN text ELSE q END")} AS qw, {_WORDS.format("CASE WHEN q = '' THEN '' ELSE substr(text, length(q) + 1) END")} AS aw FROM h),
z AS (SELECT b, item_id, greatest({decontamination.PASSAGE}, pow(2, ceil(log2(2 * len(w)))))::BIGINT AS l FROM b WHERE len(w) > 0),
pt AS (SELECT b, 1 AS part, w FROM b UNION ALL SELECT b, 2, qw FROM b UNION ALL SELECT b, 3, aw FROM b),
ps AS (SELECT DISTINCT b, part, k, array_to_string(w[p + 1:p + k], ' ') AS s FROM (SELECT *, least(len(w), 5) AS k FROM pt WHERE len(w) > 0), LATERAL (SELECT unnest(range(0, len(w) - k + 1)) AS p) r),
pn AS (SELECT b, count(*) FILTER (part = 1) AS n, count(*) FILTER (part = 2) AS q, count(*) FILTER (part = 3) AS a FROM ps GROUP BY b),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
ds AS (SELECT r, doc_id, kk.k, p, array_to_string(w[p + 1:p + kk.k], ' ') AS s
       FROM d, (SELECT DISTINCT k FROM ps) kk, LATERAL (SELECT unnest(range(0, len(w) - kk.k + 1)) AS p) q),
hit AS (SELECT r, doc_id, ds.k, p, s, b, part FROM ds JOIN ps USING (k, s)),
win AS (SELECT r, doc_id, b, item_id, part, p, k, s, l, unnest([p // (l // 2), p // (l // 2) - 1]) AS wn FROM hit JOIN z USING (b)),
got AS (SELECT r, doc_id, b, item_id, wn, count(DISTINCT s) FILTER (part = 1) AS n, count(DISTINCT s) FILTER (part = 2) AS q, count(DISTINCT s) FILTER (part = 3) AS a
       FROM win WHERE wn >= 0 AND p + k <= wn * (l // 2) + l GROUP BY r, doc_id, b, item_id, wn),
ok AS (SELECT r, doc_id, b, item_id, pn.n AS n_item, max(row(got.n, got.q, got.a)) AS m, count(*) AS n_passages FROM got JOIN pn USING (b)
       WHERE got.n >= ceil({decontamination.COVER} * pn.n - 1e-9) AND got.q >= ceil({decontamination.PART} * pn.q - 1e-9) AND got.a >= ceil({decontamination.PART} * pn.a - 1e-9) GROUP BY ALL)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, m[1]::BIGINT AS n_found, m[2]::BIGINT AS n_question, m[3]::BIGINT AS n_answer, n_passages::BIGINT AS n_passages FROM ok
"""

_NORMAL = "translate(trim(regexp_replace({}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH RECURSIVE msg AS (
  SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS m FROM conversations),
ln AS (SELECT m, conv_id, k, ls[k] AS line, regexp_extract(ls[k], '^[ \t]*(?:>[ \t]*)*') AS marks
       FROM (SELECT m, conv_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM msg), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS k) r),
lv AS (SELECT m, conv_id, k, line, len(marks) - len(replace(marks, '>', '')) AS level, {_NORMAL.format("substr(line, len(marks) + 1)")} AS x FROM ln),
ch AS (SELECT *, CASE WHEN level > 0 AND level <> coalesce(lag(level) OVER (PARTITION BY m ORDER BY k), 0) THEN 1 ELSE 0 END AS new FROM lv),
ps AS (SELECT *, sum(new) OVER (PARTITION BY m ORDER BY k) - 1 AS passage FROM ch),
nq AS (SELECT m, max(passage) + 1 AS n_quoted FROM ps GROUP BY m),
qt AS (SELECT m, conv_id, k, passage, level, x FROM ps WHERE level > 0 AND x <> '' AND conv_id IS NOT NULL),
ow AS (SELECT DISTINCT m, conv_id, x FROM ps WHERE level = 0 AND x <> '' AND conv_id IS NOT NULL),
qp AS (SELECT m, conv_id, passage, level, list(x ORDER BY k) AS xs FROM qt GROUP BY ALL),
ol AS (SELECT m, conv_id, list(x ORDER BY k) AS ys FROM ps WHERE level = 0 AND x <> '' AND conv_id IS NOT NULL GROUP BY ALL),
wh AS (SELECT qp.m, passage, level, len(any_value(xs)) AS n, max(ol.m) AS o FROM qp JOIN ol ON ol.conv_id = qp.conv_id AND ol.m < qp.m
       WHERE len(list_filter(range(1, len(ys) - len(xs) + 2), lambda i: ys[i:i + len(xs) - 1] = xs)) > 0 GROUP BY qp.m, passage, level),
vt AS (SELECT qt.m, passage, level, ow.m AS o, count(*) AS n FROM qt JOIN ow ON ow.conv_id = qt.conv_id AND ow.x = qt.x AND ow.m < qt.m
       WHERE NOT EXISTS (SELECT 1 FROM wh WHERE wh.m = qt.m AND wh.passage = qt.passage) GROUP BY qt.m, passage, level, ow.m),
bp AS (SELECT m, passage, level, max(row(n, o)) AS b FROM vt GROUP BY ALL UNION ALL SELECT m, passage, level, row(n, o) FROM wh),
lk AS (SELECT m, count(*) AS n_linked, max(b) FILTER (level = 1) AS b FROM bp GROUP BY m),
pa AS (SELECT m, b[2] AS o FROM lk WHERE b IS NOT NULL),
up(m, r) AS (SELECT m, o FROM pa UNION ALL SELECT up.m, pa.o FROM up JOIN pa ON pa.m = up.r),
rt AS (SELECT m, min(r) AS root FROM up GROUP BY m),
al AS (SELECT msg.*, n_quoted, coalesce(n_linked, 0) AS n_linked, pa.o, coalesce(root, msg.m) AS root
       FROM msg LEFT JOIN nq USING (m) LEFT JOIN lk USING (m) LEFT JOIN pa USING (m) LEFT JOIN rt USING (m))
SELECT al.conv_id, al.turn, al.role, n_quoted::INT AS n_quoted, n_linked::INT AS n_linked, p.turn AS reply_to, q.turn AS thread_turn,
       row_number() OVER (PARTITION BY al.conv_id ORDER BY al.root, al.m) - 1 AS position,
       CASE WHEN n_quoted > 0 THEN coalesce(trim((SELECT string_agg(line, chr(10) ORDER BY k) FROM ps WHERE ps.m = al.m AND level = 0), chr(10)), '') ELSE coalesce(al.text, '') END AS own_text
FROM al LEFT JOIN msg p ON p.m = al.o JOIN msg q ON q.m = al.root
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_embeddings": op5_embeddings,
    "op6_mixing": op6_mixing,
    "op7_quotations": op7_quotations,
    "op8_languages": op8_languages,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_tokens": op10_tokens,
}

SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op6_mixing": OP6_SQL, "op7_quotations": OP7_SQL}
