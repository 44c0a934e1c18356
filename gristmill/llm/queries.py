"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import alignment, chat, interplay, jaccard, licences, lines, merkle, mixing, pieces, repeats, toxicity, vptree, warc
from gristmill.llm.shared import small_batches, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    first = F.get("offending", F.lit(0))
    return found.select("doc_id", "held_out", "score", "predicted", "sentences", F.size("offending").alias("n_offending"), first["start"].alias("first_start"), first["end"].alias("first_end"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_conversations(rows))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':0') AS draw
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS weight,
         (SELECT sum(source_size) FROM s)::HUGEINT AS total
  FROM s),
r AS (
  SELECT *, total - coalesce(sum(3 * source_size) OVER before, 0)::HUGEINT AS words_left,
         (SELECT sum(weight) FROM w)::HUGEINT - coalesce(sum(weight) OVER before, 0)::HUGEINT AS weight_left
  FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, words_left * weight >= 3 * source_size * weight_left AS capped FROM r),
f AS (
  SELECT (SELECT total FROM w LIMIT 1) - coalesce(sum(3 * source_size) FILTER (capped), 0)::HUGEINT AS words_left,
         coalesce(sum(weight) FILTER (NOT capped), 1)::HUGEINT AS weight_left FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN 3 * source_size ELSE f.words_left * weight // f.weight_left END AS quota,
         round(CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (f.words_left * weight)::DOUBLE / f.weight_left::DOUBLE END, 6) AS target
  FROM c, f),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size)
             + greatest(0, least(size, quota % source_size - before)) END)::BIGINT AS taken
FROM o
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")))
    # Digests of responses are taken from the records as they are rebuilt.
    body = F.substring(F.col("record"), F.octet_length("header") + 1, F.col("payload_bytes").cast("int"))
    digest = F.when(F.col("record_type") == "response", F.sha2(body, 256)).otherwise(F.col("payload_digest"))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages),
g AS (SELECT digest, min(page_id) AS response FROM p GROUP BY digest)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM p JOIN g USING (digest)
"""

def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_and_next(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("places")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encoded(table(spark, sf_dir, "documents"), pieces.load())


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = repeats.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("stretches").cast("long").alias("n_stretches"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS seq FROM w),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) > 1 AS again FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM r WHERE again),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM d),
k AS (
  SELECT p.doc_id, p.place, p.word, c.place IS NOT NULL AS gone,
         c.place IS NOT NULL AND lag(c.place) OVER (PARTITION BY p.doc_id ORDER BY p.place) IS NULL AS begins
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.place = c.place),
g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_stretches,
         string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
  FROM k GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_stretches, 0)::BIGINT AS n_stretches
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return alignment.align(table(spark, sf_dir, "documents")).drop("groups")


def op13_interplay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents),
m AS (
  SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask,
         coalesce((SELECT max((quality = 1)::INT) FROM labels WHERE labels.doc_id = d.doc_id), 0) AS good,
         coalesce((SELECT max((toxic = 1)::INT) FROM labels WHERE labels.doc_id = d.doc_id), 0) AS toxic
  FROM d),
c AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs, substr('ABCDE', a.f::INT + 1, 1) || substr('ABCDE', b.f::INT + 1, 1) || substr('ABCDE', c.f::INT + 1, 1)
         || substr('ABCDE', d.f::INT + 1, 1) || substr('ABCDE', e.f::INT + 1, 1) AS filter_order
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
  SELECT filter_order, step, fs[step]::INT AS f, list_sum(list_transform(fs[1:step - 1], lambda x: (1 << x::INT)))::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
t AS (
  SELECT part, filter_order, step, f,
         sum(docs) FILTER (mask & (coalesce(before, 0) | (1 << f)) = 0) AS kept, sum(docs) FILTER (mask & coalesce(before, 0) = 0 AND mask >> f & 1 = 1) AS removed,
         sum(docs) FILTER (mask & coalesce(before, 0) <> 0 AND mask >> f & 1 = 1) AS redundant, sum(docs) FILTER (mask = 1 << f) AS unique_fails,
         sum(good) FILTER (mask & coalesce(before, 0) = 0 AND mask >> f & 1 = 1) AS good_lost, sum(toxic) FILTER (mask & coalesce(before, 0) = 0 AND mask >> f & 1 = 1) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM t
"""


QUERIES = {"op12_alignment": op12_alignment, "op13_interplay": op13_interplay, "op11_repeats": op11_repeats, "op10_pieces": op10_pieces, "op2_lines": op2_lines, "op3_chat": op3_chat, "op4_jaccard": op4_jaccard, "op5_neighbours": op5_neighbours, "op8_merkle": op8_merkle, "op9_licences": op9_licences, "op1_toxicity": op1_toxicity, "op6_mixing": op6_mixing, "op7_warc": op7_warc}
ORACLES = {"op13_interplay": OP13_SQL, "op11_repeats": OP11_SQL, "op6_mixing": OP6_SQL, "op7_warc": OP7_SQL}
