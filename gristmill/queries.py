"""The library's own queries over the standard tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import sketch, text
from gristmill.functions.rewrite import ENGINES, rewritten
from gristmill.operators import blocks, cache, limits, lookup, near_dup, request_log, usage, vectors
from gristmill.plans import payloads
from gristmill.sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- texts ----------------------------------------------------------------------------------------------------------

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_SHINGLES = "CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
_HASHES = "list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT)"
_SIGNATURES = f"""
w AS (SELECT doc_id, source, text, {_WORDS.format('text')} AS w FROM documents),
h AS (SELECT doc_id, source, text, {_HASHES} AS h FROM (SELECT doc_id, source, text, {_SHINGLES} AS s FROM w WHERE len(w) > 0)),
g AS (SELECT doc_id, source, text, list_transform(range(1, 33), lambda p: list_min(list_transform(h, lambda x: (x * (p * 48271 % 2147483647) + p * 69621) % 2147483647))) AS sig FROM h)"""
_PAIRS = f"""
{_SIGNATURES},
r AS (SELECT sig, min(doc_id) AS rep FROM g GROUP BY sig),
b AS (SELECT rep, unnest(range(0, 8)) AS band, sig FROM r),
k AS (SELECT rep, band, array_to_string(sig[band * 4 + 1:band * 4 + 4], '-') AS key FROM b),
p AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.rep < y.rep),
q AS (SELECT a, b, len(list_filter(range(1, 33), lambda i: x.sig[i] = y.sig[i])) / 32.0::DOUBLE AS sim FROM p JOIN r x ON x.rep = a JOIN r y ON y.rep = b)"""


@query(f"WITH {_PAIRS} SELECT a, b, sim FROM q WHERE sim >= 0.8")
def near_dup_pairs(spark, sf_dir):
    return near_dup.near_duplicates(_t(spark, sf_dir, "documents"))


@query(f"WITH {_SIGNATURES} SELECT min(doc_id) AS rep, count(*) AS copies, array_to_string(sig, ',') AS sig FROM g GROUP BY sig")
def minhash_signatures(spark, sf_dir):
    return near_dup.signatures(_t(spark, sf_dir, "documents")).select("rep", "copies", F.array_join("sig", ",").alias("sig"))


_MEMBERS = "SELECT doc_id, rep FROM documents LEFT JOIN (SELECT g.doc_id, min(g.doc_id) OVER (PARTITION BY g.sig) AS rep FROM g) USING (doc_id)"
#: The aggressive level: 128 permutations in 32 bands of 4.
_PAIRS_128 = _PAIRS.replace("range(1, 33)", "range(1, 129)").replace("range(0, 8)", "range(0, 32)").replace("/ 32.0", "/ 128.0")


@query(f"WITH {_SIGNATURES} {_MEMBERS}")
def minhash_members(spark, sf_dir):
    """The classes that near_dup_pairs, minhash_signatures and leader_dedupe name by rep."""
    return near_dup.signature_members(_t(spark, sf_dir, "documents"))


@query(f"WITH {_PAIRS_128} SELECT a, b, sim FROM q WHERE sim >= 0.8")
def near_dup_pairs_aggressive(spark, sf_dir):
    level = near_dup.LEVELS["aggressive"]
    return near_dup.near_duplicates(_t(spark, sf_dir, "documents"), perms=level.bands * level.rows, bands=level.bands, threshold=level.threshold)


@query(f"WITH {_PAIRS_128} {_MEMBERS}")
def near_dup_members_aggressive(spark, sf_dir):
    level = near_dup.LEVELS["aggressive"]
    return near_dup.signature_members(_t(spark, sf_dir, "documents"), perms=level.bands * level.rows)


@query(f"""
WITH RECURSIVE {_PAIRS},
e AS (SELECT a, b, sim FROM q WHERE sim >= 0.8),
n AS (SELECT rep, row_number() OVER (ORDER BY rep) AS i FROM r WHERE rep IN (SELECT a FROM e UNION SELECT b FROM e)),
f(i, gone) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT f.i + 1, CASE WHEN (SELECT count(*) FROM e WHERE e.b = n.rep AND NOT list_contains(f.gone, e.a)) > 0 THEN list_append(f.gone, n.rep) ELSE f.gone END
  FROM f JOIN n ON n.i = f.i + 1),
z AS (SELECT gone FROM f ORDER BY i DESC LIMIT 1),
m AS (SELECT b, max({{'sim': sim, 'a': -a}}) AS best FROM e, z WHERE list_contains(z.gone, b) AND NOT list_contains(z.gone, a) GROUP BY b)
SELECT r.rep AS id, -m.best.a AS leader, m.best.sim AS sim FROM r LEFT JOIN m ON m.b = r.rep""")
def leader_dedupe(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    sigs = near_dup.written(near_dup.signatures(docs))
    reps = sigs.select(F.col("rep").alias("id"), F.lit("all").alias("grp"))
    # Rows without a near one are leaders whatever the order: only the others are folded.
    pairs = near_dup.written(near_dup.agreeing(sigs))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    folded = near_dup.leaders(reps.join(ends, "id", "left_semi"), pairs)
    return reps.select("id").join(folded.select("id", "leader", "sim"), "id", "left").select("id", "leader", "sim")


@query(f"""
WITH s AS (SELECT doc_id, list_distinct({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) > 0),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
k AS (SELECT x.doc_id AS query_id, y.doc_id AS id, count(*) AS k, any_value(x.n) AS m, any_value(y.n) AS n FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id WHERE x.doc_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, id, k / (n + m - k)::DOUBLE AS sim, row_number() OVER (PARTITION BY query_id ORDER BY k / (n + m - k)::DOUBLE DESC, id) AS r FROM k)
SELECT query_id, id, sim FROM r WHERE r = 1""")
def jaccard_nearest(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return near_dup.exact_nearest(docs, docs.filter("doc_id % 20 = 0"))


_SIMHASH = f"""
w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
s AS (SELECT doc_id, list_transform({_SHINGLES}, lambda x: ('0x' || substr(md5(x), 1, 14))::BIGINT) AS h FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, list_sum(list_transform(range(0, 56), lambda j: CASE WHEN list_sum(list_transform(h, lambda x: CASE WHEN (x >> j::BIGINT) & 1 = 1 THEN 1 ELSE -1 END)) > 0 THEN 1::BIGINT << j::BIGINT ELSE 0 END))::BIGINT AS h FROM s)"""


@query(f"WITH {_SIMHASH} SELECT doc_id, coalesce(h, 0) AS h FROM documents LEFT JOIN h USING (doc_id)")
def simhash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", sketch.simhash(F.col("text")).alias("h"))


@query(f"""
WITH {_SIMHASH},
r AS (SELECT h, min(doc_id) AS id FROM h WHERE h <> 0 GROUP BY h)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS hamming FROM r x JOIN r y ON x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 3""")
def simhash_pairs(spark, sf_dir):
    return near_dup.simhash_pairs(_t(spark, sf_dir, "documents"))


@query(f"WITH {_SIMHASH} SELECT doc_id, CASE WHEN h <> 0 THEN min(doc_id) OVER (PARTITION BY h) END AS rep FROM documents LEFT JOIN h USING (doc_id)")
def simhash_members(spark, sf_dir):
    """The classes that simhash_pairs names by their smallest ids."""
    return near_dup.simhash_members(_t(spark, sf_dir, "documents"))


@query()
def projection_nearest(spark, sf_dir):
    return near_dup.projection_nearest(_t(spark, sf_dir, "documents"))


@query(r"""
WITH c AS (
  SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper,
         length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) AS digits, length(regexp_replace(text, '[\p{L}\p{Nd}\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g')) AS marks,
         len(regexp_extract_all(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+')) AS gaps
  FROM documents)
SELECT doc_id, CASE WHEN n IS NULL OR n = 0 THEN 0
  WHEN (letters > 0 AND upper / letters > 0.6) OR marks > greatest(1, floor(n * 0.3)) THEN greatest(1, round_even(n / 3.5, 0))
  ELSE greatest(1, round_even(letters / 4.0 + digits / 2.0 + marks + gaps * 0.5, 0)) END::INT AS tokens FROM c""")
def token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""
WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n, substr(sha256(text), 1, 16) AS d FROM documents),
m0 AS (SELECT *, 130 + 0 AS z FROM t WHERE n > 4000),
s0 AS (SELECT *, 4000 AS mx, E'\n\n[... middle-out compressed locally: omitted ' AS p1, ' chars; original_chars=' || n || '; sha256=' || d || E'; not reversible by the model ...]\n\n' AS p2 FROM m0),
i0 AS (SELECT *, p1 || (n - mx) || p2 AS mark FROM s0),
e0 AS (SELECT *, greatest(64, floor(greatest(128, mx - length(mark)) * 0.55))::INT AS head FROM i0),
f0 AS (SELECT *, greatest(64, greatest(128, mx - length(mark)) - head)::INT AS tail FROM e0),
f1 AS (SELECT *, p1 || (n - head - tail) || p2 AS new1 FROM f0),
e1 AS (SELECT *, CASE WHEN length(new1) = length(mark) THEN head ELSE greatest(64, floor(greatest(128, mx - length(new1)) * 0.55))::INT END AS head1 FROM f1),
t1 AS (SELECT *, CASE WHEN length(new1) = length(mark) THEN tail ELSE greatest(64, greatest(128, mx - length(new1)) - head1)::INT END AS tail1 FROM e1),
f2 AS (SELECT *, CASE WHEN length(new1) = length(mark) THEN new1 ELSE p1 || (n - head1 - tail1) || p2 END AS new2 FROM t1),
e2 AS (SELECT *, CASE WHEN length(new2) = length(new1) THEN head1 ELSE greatest(64, floor(greatest(128, mx - length(new2)) * 0.55))::INT END AS head2 FROM f2),
t2 AS (SELECT *, CASE WHEN length(new2) = length(new1) THEN tail1 ELSE greatest(64, greatest(128, mx - length(new2)) - head2)::INT END AS tail2 FROM e2),
f3 AS (SELECT *, CASE WHEN length(new2) = length(new1) THEN new2 ELSE p1 || (n - head2 - tail2) || p2 END AS new3 FROM t2),
o AS (SELECT doc_id, CASE WHEN head + tail >= n - 500 THEN text ELSE regexp_replace(substr(text, 1, head2), '\s+$', '') || new3 || regexp_replace(substr(text, n - tail2 + 1), '^\s+', '') END AS out FROM f3)
SELECT t.doc_id, length(coalesce(o.out, t.text)) AS chars, substr(sha256(coalesce(o.out, t.text)), 1, 16) AS digest FROM t LEFT JOIN o USING (doc_id)""")
def middle_out(spark, sf_dir):
    out = _t(spark, sf_dir, "documents").select("doc_id", text.middle_out(F.col("text"), 4000).alias("o"))
    return out.select("doc_id", F.length("o").cast("long").alias("chars"), text.short_digest(F.col("o")).alias("digest"))


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE 1 END AS some FROM conversations)
SELECT conv_id, sum(n)::BIGINT AS chars, sum(n) >= 2048 AS worth,
  CASE WHEN sum(n) / 4.0 / 2000 < 0.4 THEN 'lenient' WHEN sum(n) / 4.0 / 2000 < 0.6 THEN 'standard' WHEN sum(n) / 4.0 / 2000 < 0.8 THEN 'aggressive' ELSE 'max' END AS tier,
  CASE WHEN sum(n) / 4.0 / 2000 < 0.4 THEN 'lite' WHEN sum(n) / 4.0 / 2000 < 0.6 THEN 'standard' WHEN sum(n) / 4.0 / 2000 < 0.8 THEN 'aggressive' ELSE 'ultra' END AS caveman
FROM t GROUP BY conv_id""")
def context_tiers(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    rows = rows.withColumn("tier", lookup.tier(F.col("chars"), 2000))
    return rows.select("conv_id", "chars", lookup.worth_compacting(F.col("chars")).alias("worth"), "tier", lookup.tier_level(F.col("tier"), "caveman").alias("caveman"))


def _rewritten(name: str, level: str, column: str):
    def run(spark, sf_dir):
        rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", rewritten(F.col("text"), name, level).alias("r"))
        return rows.select("conv_id", "turn", F.col("r.text").alias("text"), F.col("r.note").alias("note"), F.col("r.original_chars").alias("chars_in"), F.col("r.compressed_chars").alias("chars_out"))

    run.__name__ = f"rewrite_{name}"
    return run


for _name, (_, _levels) in ENGINES.items():
    QUERIES[f"rewrite_{_name}"] = _rewritten(_name, _levels[-1], "text")


# ---- vectors --------------------------------------------------------------------------------------------------------

_COS = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_COS}, 6) AS sim FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)
SELECT query_id, id, sim, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id))::INT AS rank FROM s QUALIFY rank <= 5""")
def vector_topk(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    return vectors.top_k(rows, rows.filter("vec_id % 20 = 0"), 5)


@query("""
WITH c AS (
  SELECT vec_id, embedding, 1 AS seq, FALSE AS deleted FROM embeddings
  UNION ALL SELECT vec_id, NULL, 2, TRUE FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, list_reverse(embedding), 3, FALSE FROM embeddings WHERE vec_id % 6 = 0
  UNION ALL SELECT vec_id, embedding, 0, FALSE FROM embeddings WHERE vec_id % 9 = 0)
SELECT DISTINCT ON (vec_id) vec_id, seq::BIGINT AS seq, deleted, round(embedding[1]::DOUBLE, 6) AS first FROM c ORDER BY vec_id, seq DESC""")
def vector_table(spark, sf_dir):
    """Vectors stored, a third deleted, half of these stored again, and old changes that come late."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    change = lambda df, seq, gone, v: df.select("vec_id", v.alias("embedding"), F.lit(seq).cast("long").alias("seq"), F.lit(gone).alias("deleted"))
    v, none = F.col("embedding"), F.lit(None).cast("array<double>")
    table = vectors.upserted(change(rows, 1, False, v), change(rows.filter("vec_id % 3 = 0"), 2, True, none))
    table = vectors.upserted(table, change(rows.filter("vec_id % 6 = 0"), 3, False, F.reverse(v)).unionByName(change(rows.filter("vec_id % 9 = 0"), 0, False, v)))
    return table.select("vec_id", "seq", "deleted", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_COS}, 6) AS sim FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s)
SELECT query_id, id, sim FROM r WHERE r = 1 AND sim >= 0.97""")
def semantic_hits(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    return vectors.semantic_hits(rows, rows.filter("vec_id % 20 = 0"))


# ---- the request log ------------------------------------------------------------------------------------------------

_EDGES = "[" + ", ".join(f"{float(e)}" for e in request_log.EDGES) + "]"


def _quantile_sql(q: float) -> str:
    tops = _EDGES[:-1] + ", 240000.0]"
    return f"coalesce(({tops})[list_filter(range(1, 18), lambda i: list_sum(hist[1:i]) >= greatest(1, ceil({q} * requests)))[1]], 0.0)"


_BUCKETS = f"""
e AS (SELECT *, len(list_filter({_EDGES}, lambda x: x < value)) AS bin FROM events),
m AS (
  SELECT date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 3) AS total_ms,
         [{', '.join(f'count(*) FILTER (bin = {i})' for i in range(17))}] AS hist
  FROM e GROUP BY 1)"""


@query(f"""
WITH {_BUCKETS}
SELECT strftime(minute, '%Y-%m-%d %H:%M') AS minute, requests, errors, total_ms, array_to_string(hist, ',') AS hist,
       {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95, {_quantile_sql(0.99)} AS p99 FROM m""")
def minute_buckets(spark, sf_dir):
    out = request_log.minute_buckets(_t(spark, sf_dir, "events"), ms="value", bad=F.col("event_type") == "error")
    return out.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm")).withColumn("hist", F.array_join("hist", ","))


@query(f"""
WITH {_BUCKETS.replace("'minute'", "'hour'")}
SELECT strftime(minute, '%Y-%m-%d %H') AS hour, {_quantile_sql(0.95)} AS p95 FROM m""")
def latency_p95(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(request_log.histogram(F.col("value")).alias("h"))
    return rows.select("hour", request_log.quantile(F.col("h"), 0.95).alias("p95"))


@query("""
SELECT count(*) AS requests, count(*) FILTER (event_id % 100 > floor(value)) AS compacted, sum(greatest(0, event_id % 100 - floor(value)::INT))::BIGINT AS saved,
       count(*) FILTER (event_type = 'error') AS errors FROM events""")
def request_totals(spark, sf_dir):
    return request_log.totals(_t(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("event_id") % 100, F.floor("value"))


@query("SELECT event_type AS mode, sum(greatest(0, event_id % 100 - user_id))::BIGINT AS saved FROM events GROUP BY 1")
def engine_savings(spark, sf_dir):
    event = F.struct(F.col("event_type").alias("mode"), (F.col("event_id") % 100).alias("original_chars"), F.col("user_id").alias("compressed_chars"))
    return request_log.engine_savings(_t(spark, sf_dir, "events").select(F.array(event).alias("events")))


@query("SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def recent_requests(spark, sf_dir):
    return request_log.recent(_t(spark, sf_dir, "events"), 50).select("event_id", "user_id", "event_type")


_SERIES = """
SELECT 0 AS f, 0 AS p, NULL AS o, 'requests_total' AS n, 'counter' AS k, 'Requests seen.' AS h, count(*)::VARCHAR AS v FROM e
UNION ALL SELECT 1, 0, NULL, 'compressed_requests_total', 'counter', 'Requests that something was saved on.', count_if(i > 0 OR o > 0)::VARCHAR FROM e
UNION ALL SELECT 2, 0, NULL, 'upstream_errors_total', 'counter', 'Requests that failed.', count_if(bad)::VARCHAR FROM e
UNION ALL SELECT 3, 0, NULL, 'chars_saved_in_total', 'counter', 'Characters saved on requests.', sum(i)::VARCHAR FROM e
UNION ALL SELECT 4, 0, NULL, 'chars_saved_out_total', 'counter', 'Characters saved on responses.', sum(o)::VARCHAR FROM e
UNION ALL SELECT 5, 0, NULL, 'protected_blocks_total', 'counter', 'Blocks left alone before a marker.', '0'
UNION ALL SELECT 6, 0, NULL, 'cache_hits_total', 'counter', 'Texts found rewritten before.', '0'
UNION ALL SELECT 7, 0, NULL, 'cache_misses_total', 'counter', 'Texts that had to be rewritten.', '0'
UNION ALL SELECT 100, 0, NULL, 'uptime_seconds', 'gauge', 'Seconds since the start.', printf('%.6f', max(event_id) / 8.0) FROM e
UNION ALL SELECT 101, 0, NULL, 'cache_size', 'gauge', 'Entries held.', '0'
UNION ALL SELECT 102, 0, NULL, 'cache_max_entries', 'gauge', 'Entries that are held at most.', '0'
UNION ALL SELECT 200, 0, 'input', 'input_compression_enabled', 'gauge', 'Whether requests are compacted.', '1'
UNION ALL SELECT 300, u, event_type, 'engine_enabled', 'gauge', 'Whether an engine is on.', (u > 50)::INT::VARCHAR FROM (SELECT event_type, min(user_id)::INT AS u FROM e GROUP BY event_type)
UNION ALL SELECT 500, 0, event_type, 'engine_chars_saved_total', 'counter', 'Characters saved by each engine.', sum(i)::VARCHAR FROM e WHERE i > 0 GROUP BY event_type
UNION ALL SELECT 600, 0, NULL, 'similarity_threshold', 'gauge', 'Similarity from which texts are near-duplicates.', '0.985000'"""


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type || '"\\' AS event_type, event_id % 50 - 9 AS x, greatest(0, event_id % 50 - 9) AS i, user_id % 3 AS o, event_type = 'error' OR event_id % 10 = 0 AS bad FROM events),
s AS ({_SERIES}),
l AS (
  SELECT f, p, o, unnest([0, 1, 2]) AS i, unnest(['# HELP t_' || n || ' ' || h, '# TYPE t_' || n || ' ' || k, 't_' || n || CASE WHEN o IS NULL THEN '' ELSE '{{' || CASE WHEN f = 400 THEN 'feature' ELSE 'engine' END || '="' || replace(replace(o, '\\', '\\\\'), '"', '\\"') || '"}}' END || ' ' || v]) AS line,
         row_number() OVER (PARTITION BY f ORDER BY p, o) = 1 AS first FROM s)
SELECT (row_number() OVER (ORDER BY f, p, o NULLS FIRST, i) - 1)::INT AS at, line FROM l WHERE i = 2 OR first""")
def metrics_exposition(spark, sf_dir):
    """All series over all events, with labels that have to be escaped."""
    e = _t(spark, sf_dir, "events").withColumn("event_type", F.concat("event_type", F.lit('"\\'))).withColumn("i", F.greatest(F.lit(0), F.col("event_id") % 50 - 9))
    bad = F.col("event_type").startswith('error"') | (F.col("event_id") % 10 == 0)
    totals = request_log.all_totals(e, bad, F.col("i"), F.col("user_id") % 3, F.lit(0), F.lit(0))
    totals = totals.crossJoin(e.agg((F.max("event_id") / 8.0).alias("uptime_s"))).withColumn("similarity", F.lit(0.985))
    engines = request_log.engine_totals(e, F.create_map("event_type", "i"))
    on = e.groupBy(F.col("event_type").alias("name")).agg(F.min("user_id").cast("int").alias("place")).select(F.lit("engine").alias("family"), "place", "name", (F.col("place") > 50).alias("enabled"))
    switches = on.unionByName(spark.range(1).select(F.lit("input").alias("family"), F.lit(0).alias("place"), F.lit("input").alias("name"), F.lit(True).alias("enabled")))
    return logs.exposition(totals, engines, switches, "t")


@query("""
WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM r GROUP BY user_id, run, event_type""")
def run_islands(spark, sf_dir):
    return request_log.runs(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""
WITH s AS (SELECT event_id AS seq, user_id AS key FROM events),
p AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS before FROM s),
d AS (SELECT p.seq, count(DISTINCT o.key) AS d FROM p JOIN s o ON o.seq > p.before AND o.seq < p.seq AND o.key <> p.key GROUP BY 1)
SELECT 0 AS cache, p.seq, p.key, p.before IS NOT NULL AND coalesce(d.d, 0) < 40 AS hit FROM p LEFT JOIN d USING (seq)""")
def lru_hits(spark, sf_dir):
    """One cache over all events."""
    rows = _t(spark, sf_dir, "events").select(F.lit(0).alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    return request_log.lru_hits(rows, 40)


@query("""
WITH RECURSIVE c AS (SELECT user_id AS client, event_id AS seq, epoch_us(ts) / 1e6 AS ts, (event_id % 3)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS i FROM events),
f AS (
  SELECT client, seq, i, ts, cost <= 0 OR 5.0 >= cost AS allowed, CASE WHEN cost > 0 AND 5.0 >= cost THEN 5.0 - cost ELSE 5.0 END AS tokens FROM c WHERE i = 1
  UNION ALL
  SELECT c.client, c.seq, c.i, c.ts, c.cost <= 0 OR least(5.0, f.tokens + (c.ts - f.ts) * 0.00001) >= c.cost,
         CASE WHEN c.cost > 0 AND least(5.0, f.tokens + (c.ts - f.ts) * 0.00001) >= c.cost THEN least(5.0, f.tokens + (c.ts - f.ts) * 0.00001) - c.cost ELSE least(5.0, f.tokens + (c.ts - f.ts) * 0.00001) END
  FROM f JOIN c ON c.client = f.client AND c.i = f.i + 1)
SELECT client, seq, allowed, round(tokens, 6) AS tokens FROM f""")
def rate_limit(spark, sf_dir):
    calls = _t(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("event_id") % 3).alias("cost"))
    return limits.limited(calls, 5.0, 0.00001).withColumn("tokens", F.round("tokens", 6))


# ---- lookups, costs, budgets ----------------------------------------------------------------------------------------

_MODELS = ["claude-opus-4-x", "claude-3-5-sonnet-latest", "gpt-4o-mini-1", "gpt-4o-2", "gemini-1.5-pro", "unknown-1"]
_PRICE_VALUES = ", ".join(f"('{p}', '{m}', {a}, {b}, {c if c is not None else 'NULL'}, {d if d is not None else 'NULL'})" for p, m, a, b, c, d in lookup.PRICES)
_REQUESTS = f"""
r AS (
  SELECT event_id, ({_MODELS!r})[event_id % 6 + 1] AS model, (event_id % 100 - 5)::BIGINT AS input_tokens, user_id::BIGINT AS output_tokens,
         (event_id % 7)::BIGINT AS cache_write_tokens, (event_id % 11)::BIGINT AS cache_read_tokens FROM events),
v AS (SELECT *, CASE WHEN model LIKE 'claude%' THEN 'anthropic' WHEN model LIKE 'gpt%' THEN 'openai' WHEN model LIKE 'gemini%' THEN 'google' ELSE 'other' END AS provider FROM r),
p(provider, prefix, a, b, c, d) AS (VALUES {_PRICE_VALUES}),
m AS (SELECT v.*, p.prefix, p.a, p.b, p.c, p.d, row_number() OVER (PARTITION BY event_id ORDER BY length(prefix) DESC NULLS LAST) AS k FROM v LEFT JOIN p ON p.provider = v.provider AND starts_with(v.model, p.prefix)),
u AS (
  SELECT *, prefix IS NOT NULL AS matched, coalesce(round(greatest(0, input_tokens) * coalesce(a::DOUBLE, 0) / 1000000 + greatest(0, output_tokens) * coalesce(b::DOUBLE, 0) / 1000000
         + greatest(0, cache_write_tokens) * coalesce(c::DOUBLE, 0) / 1000000 + greatest(0, cache_read_tokens) * coalesce(d::DOUBLE, 0) / 1000000, 8), 0) AS usd
  FROM m WHERE k = 1)"""


def _requests(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(
        "event_id", F.get(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % 6).cast("int")).alias("model"), (F.col("event_id") % 100 - 5).alias("input_tokens"),
        F.col("user_id").alias("output_tokens"), (F.col("event_id") % 7).alias("cache_write_tokens"), (F.col("event_id") % 11).alias("cache_read_tokens"),
    )
    return rows.withColumn("provider", lookup.route(F.col("model"), F.lit(None).cast("string"), [("anthropic", ["claude*"]), ("openai", ["gpt*"]), ("google", ["gemini*"])], "other"))


@query(f"WITH {_REQUESTS} SELECT event_id, provider, prefix, round(usd * 1e8)::BIGINT AS usd_e8, matched FROM u")
def prefix_prices(spark, sf_dir):
    rows = lookup.longest_prefix(_requests(spark, sf_dir), lookup.prices(spark))
    return rows.select("event_id", "provider", F.col("price.prefix").alias("prefix"), F.round(usage.usd(F.col("price")) * 1e8).cast("long").alias("usd_e8"), F.col("price").isNotNull().alias("matched"))


@query(f"""
WITH {_REQUESTS}
SELECT provider, model, count(*) AS requests, sum(greatest(0, input_tokens))::BIGINT AS input_tokens, sum(greatest(0, output_tokens))::BIGINT AS output_tokens,
       sum(greatest(0, cache_write_tokens))::BIGINT AS cache_write_tokens, sum(greatest(0, cache_read_tokens))::BIGINT AS cache_read_tokens,
       round(sum(usd), 4) AS usd, count(*) FILTER (NOT matched) AS unmatched, grouping(provider, model) > 0 AS total
FROM u GROUP BY GROUPING SETS ((provider, model), ())""")
def cost_rollup(spark, sf_dir):
    return usage.rollup(usage.priced(_requests(spark, sf_dir), lookup.prices(spark))).withColumn("usd", F.round("usd", 4))


@query("""
SELECT event_id, CASE WHEN event_type LIKE 'c%' AND user_id % 2 = 0 THEN 'first' WHEN regexp_matches(event_type, '^.i.*$') THEN 'second' WHEN user_id % 2 = 1 THEN 'third' END AS policy FROM events""")
def policy_match(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "messages").otherwise("count").alias("endpoint"))
    return lookup.first_rule(rows, [("c*", "messages", "first"), ("?i*", "*", "second"), ("*", "count", "third")]).select("event_id", "policy")


@query("""
SELECT user_id, event_id AS seq, sum(event_id % 50) OVER w AS used, greatest(0, 1000 - sum(event_id % 50) OVER w) AS remaining, sum(event_id % 50) OVER w >= 1000 AS exceeded
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""".replace("sum(event_id % 50) OVER w", "(sum(event_id % 50) OVER w)::BIGINT"))
def budget_running(spark, sf_dir):
    calls = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("chars"))
    return usage.running_budget(calls, 1000, by="user_id").drop("chars")


@query("""
SELECT event_id AS seq, (sum(event_id % 50) OVER w)::BIGINT AS used_chars, greatest(0, 1000000 - sum(event_id % 50) OVER w)::BIGINT AS remaining_chars, sum(event_id % 50) OVER w >= 1000000 AS exceeded_chars,
       (sum(user_id) OVER w)::BIGINT AS used_tokens, greatest(0, 5000 - sum(user_id) OVER w)::BIGINT AS remaining_tokens, sum(user_id) OVER w >= 5000 AS exceeded_tokens
FROM events WINDOW w AS (ORDER BY event_id)""")
def budget_total(spark, sf_dir):
    """One budget over all events, on two axes."""
    calls = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("chars"), F.col("user_id").alias("tokens"))
    return usage.running_budgets(calls, {"chars": 1_000_000, "tokens": 5000}).drop("chars", "tokens")


# ---- cache ----------------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT event_id, sha256(props) AS key, value FROM events),
k AS (SELECT key, min(event_id) AS stored, count(*) AS n FROM e GROUP BY key)
SELECT event_id, e.event_id > k.stored AS hit FROM e JOIN k USING (key)""")
def exact_lookup(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.sha2("props", 256).alias("cache_key"))
    entries = rows.groupBy("cache_key").agg(F.min("event_id").alias("stored"))
    return cache.lookups(rows, entries).select("event_id", (F.col("hit") & (F.col("event_id") > F.col("stored"))).alias("hit"))


@query("SELECT count(*) AS entries, sum(n)::BIGINT AS bytes, sum(c)::BIGINT AS hits FROM (SELECT props, length(props) AS n, count(*) AS c FROM events WHERE value <= 200 GROUP BY props)")
def cache_stats(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").filter(cache.admitted(F.lit(200), F.col("value"), 200))
    return cache.stats(rows.groupBy("props").agg(F.count("*").alias("hit_count"), F.first(F.length("props")).alias("body_bytes")))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS cache_key FROM events")
def cache_keys(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", cache.cache_key(cache.canonical(F.col("props"))).alias("cache_key"))


# ---- conversations as requests --------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT event_id AS ts, user_id AS k, CASE WHEN event_id = 300 THEN 'purge' WHEN event_id % 7 = 0 THEN 'put' ELSE 'hit' END AS op, CASE WHEN event_id % 35 = 0 THEN 500 ELSE 200 END AS status, props FROM events),
s AS (SELECT * FROM e WHERE ts > 300),
p AS (SELECT k, max(ts) AS at FROM s WHERE op = 'put' AND status = 200 GROUP BY k),
h AS (SELECT s.k, count(*) AS n, max(ts) AS last FROM s JOIN p ON p.k = s.k AND s.ts > p.at AND op = 'hit' GROUP BY s.k)
SELECT 'k' || p.k AS cache_key, p.at::DOUBLE AS inserted_at, coalesce(last, p.at)::DOUBLE AS last_hit_at, coalesce(n, 0)::BIGINT AS hit_count, strlen(e.props)::BIGINT AS body_bytes, md5(e.props) AS body
FROM p JOIN e ON e.ts = p.at LEFT JOIN h ON h.k = p.k ORDER BY last_hit_at DESC, inserted_at DESC, cache_key LIMIT 40""")
def cache_merge(spark, sf_dir):
    """Events as puts, hits and a purge of a cache that keeps 40 entries."""
    n = F.col("event_id")
    op = F.when(n == 300, "purge").when(n % 7 == 0, "put").otherwise("hit")
    deltas = _t(spark, sf_dir, "events").select(
        op.alias("op"), F.concat(F.lit("k"), "user_id").alias("cache_key"), n.cast("double").alias("ts"), n.alias("seq"), F.when(n % 35 == 0, 500).otherwise(200).alias("status_code"),
        F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.col("props").cast("binary").alias("body"), F.lit("text/plain").alias("media_type"),
    )
    out = cache.merged(spark.createDataFrame([], cache.ENTRY), deltas, 40)
    return out.select("cache_key", "inserted_at", "last_hit_at", "hit_count", "body_bytes", F.md5("body").alias("body"))


@query("""
WITH t AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS wall FROM conversations)
SELECT conv_id, turn, coalesce(turn <= wall, FALSE) AS protected FROM t""")
def wall_protection(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"), F.lit("message").alias("kind"), F.col("turn").alias("msg_idx"), F.lit(0).alias("block_idx"), F.lit(None).cast("int").alias("sub_idx"),
        "role", F.lit("text").alias("block_type"), "text", F.coalesce(F.col("role") == "system", F.lit(False)).alias("has_marker"),
    )
    return blocks.with_wall(rows).select(F.col("request_id").alias("conv_id"), F.col("msg_idx").alias("turn"), "protected")


@query("""
SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars_in, sum(least(length(text), 200))::BIGINT AS chars_out,
       round(100.0 * sum(greatest(0, length(text) - 200)) / sum(length(text)), 4) AS saved_pct FROM documents GROUP BY source""")
def audit_sums(spark, sf_dir):
    n = F.length("text")
    return _t(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(n).alias("chars_in"), F.sum(F.least(n, F.lit(200))).alias("chars_out"), F.round(100.0 * F.sum(F.greatest(F.lit(0), n - 200)) / F.sum(n), 4).alias("saved_pct")
    )


def _blocks(spark, sf_dir):
    """Conversations as blocks: pairs of turns make a message of two texts."""
    return _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"), F.lit("message").alias("kind"), F.floor(F.col("turn") / 2).cast("int").alias("msg_idx"), F.lit(0).alias("block_idx"),
        (F.col("turn") % 2).cast("int").alias("sub_idx"), "role", F.lit("tool_result").alias("block_type"), "text", F.lit(False).alias("has_marker"),
    )


@query("""
SELECT DISTINCT ON (conv_id, floor(turn / 2)) conv_id, 'messages[' || floor(turn / 2)::INT || '].content[0].content[' || turn % 2 || ']' AS path, length(text) AS chars
FROM conversations ORDER BY conv_id, floor(turn / 2), length(text) DESC NULLS LAST, turn""")
def largest_blocks(spark, sf_dir):
    return blocks.largest_sub(_blocks(spark, sf_dir)).select(F.col("request_id").alias("conv_id"), blocks.block_path().alias("path"), F.length("text").cast("long").alias("chars"))


_TOKENS = ORACLES["token_estimate"].replace("doc_id", "role, conv_id").replace("documents", "conversations")


@query(f"WITH t AS ({_TOKENS}) SELECT conv_id, coalesce(role, CASE WHEN grouping(role) = 0 THEN 'unknown' END) AS role, sum(tokens)::BIGINT AS tokens, grouping(role) = 1 AS total FROM t GROUP BY GROUPING SETS ((conv_id, role), (conv_id))")
def token_totals(spark, sf_dir):
    return blocks.token_totals(_blocks(spark, sf_dir)).withColumnRenamed("request_id", "conv_id")


@query("""
SELECT sum(length(text))::BIGINT AS chars_in, sum(least(length(text), 80))::BIGINT AS chars_out, sum(length(text) - least(length(text), 80))::BIGINT AS saved,
       round(100.0 * sum(length(text) - least(length(text), 80)) / sum(length(text)), 2) AS saved_pct FROM conversations""")
def preview_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("text", F.substring("text", 1, 80).alias("cut"))
    return blocks.preview(rows, "text", "cut").select("chars_in", "chars_out", "saved", "saved_pct")


@query("""
SELECT conv_id, turn, role <> 'user' OR left(text, 20) = left(replace(text, 'e', 'é'), 20) AS kept FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL""")
def prefix_kept(spark, sf_dir):
    """An edit that makes texts longer in bytes, compared over as many bytes as 20 characters of the original have."""
    rows = _t(spark, sf_dir, "conversations").filter("text is not null and role is not null")
    kept = blocks.prefix_unchanged(F.col("text"), F.replace("text", F.lit("e"), F.lit("é")), F.col("role") == "user", F.octet_length(F.substring("text", 1, 20)))
    return rows.select("conv_id", "turn", kept.alias("kept"))


def _literal(text):
    """A string as JSON writes it."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


_RID = "conv_id || '-' || turn AS request_id, coalesce(role, '') AS role, coalesce(text, '') AS text"
_TOOLS = '"tools": [{"name": "a"}, {"name" :"b"} ], '


def _payloads(spark, sf_dir):
    """Each turn as a request with texts in all places, some of them looking like lists; even turns have tools."""
    role, said = _literal(F.col("role")), lambda head: _literal(F.concat(F.lit(head), F.coalesce("text", F.lit(""))))
    parts = [
        F.lit('{"system": "[sys]", '), F.when(F.col("turn") % 2 == 0, F.lit(_TOOLS)).otherwise(""), F.lit('"messages" : [{"role":'), role, F.lit(', "content":'), said("[turn] "),
        F.lit('},\n {"content": [{"type": "text", "text": '), said(""), F.lit('}, {"type": "tool_result", "content": '), said("[2024] "),
        F.lit('}, {"type": "tool_result", "content": [{"type": "image"}, {"type": "text", "text": '), said("{}"), F.lit("}]}]}]}"),
    ]
    return _t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.concat(*parts).alias("payload"))


_TEXTS = """
SELECT request_id, 'system' AS path, NULL AS role, '[sys]' AS text FROM r
UNION ALL SELECT request_id, 'messages[0].content', role, '[turn] ' || text FROM r
UNION ALL SELECT request_id, 'messages[1].content[0].text', NULL, text FROM r
UNION ALL SELECT request_id, 'messages[1].content[1].content', NULL, '[2024] ' || text FROM r
UNION ALL SELECT request_id, 'messages[1].content[2].content[1].text', NULL, '{}' || text FROM r
UNION ALL SELECT request_id, 'tools[' || i || '].text', NULL, NULL FROM r, (SELECT unnest([0, 1]) AS i) WHERE turn % 2 = 0"""


@query(f"WITH r AS (SELECT {_RID}, turn FROM conversations), t AS ({_TEXTS}) SELECT request_id, path, role, length(text)::INT AS chars, md5(text) AS digest FROM t")
def payload_blocks(spark, sf_dir):
    rows = blocks.blocks(_payloads(spark, sf_dir))
    return rows.select("request_id", blocks.json_path().alias("path"), "role", F.length("text").alias("chars"), F.md5("text").alias("digest"))


_WRITTEN = """'{"system": ' || %s || ', ' || CASE WHEN turn %% 2 = 0 THEN %s ELSE '' END || '"messages" : [{"role":' || to_json(role) || ', "content":' || to_json(%s) || E'},\\n {"content": [{"type": "text", "text": '
  || to_json(%s) || '}, {"type": "tool_result", "content": ' || to_json(%s) || '}, {"type": "tool_result", "content": [{"type": "image"}, {"type": "text", "text": ' || to_json(%s) || '}]}]}]}'"""
_SAID = ("'[turn] ' || text", "text", "'[2024] ' || text", "'{}' || text")
_MARKED_SYSTEM = """CASE WHEN turn % 2 = 0 THEN '"[sys]"' ELSE '[{"type": "text", "text": "[sys]", "cache_control": {"type": "ephemeral"}}]' END"""
_MARKED_TOOLS = _TOOLS.replace('"b"}', '"b", "cache_control": {"type": "ephemeral"}}')


@query(f"SELECT request_id, md5({_WRITTEN % (_MARKED_SYSTEM, repr(_MARKED_TOOLS), *_SAID)}) AS digest FROM (SELECT {_RID}, turn FROM conversations)")
def marked_payloads(spark, sf_dir):
    """The last tool gets a marker, or else the system, promoted to a list; all else keeps its bytes."""
    return payloads.marked(_payloads(spark, sf_dir)).select("request_id", F.md5("payload").alias("digest"))


@query(f"SELECT request_id, md5({_WRITTEN % (repr(chr(34) + '[sys]' + chr(34)), repr(_TOOLS), *(f'left({x}, 20)' for x in _SAID))}) AS digest FROM (SELECT {_RID}, turn FROM conversations)")
def shortened_payloads(spark, sf_dir):
    """Message texts cut to 20 characters, in place."""
    return payloads.shortened_tail(_payloads(spark, sf_dir), lambda t: F.substring(t, 1, 20))[0].select("request_id", F.md5("payload").alias("digest"))


@query(f"""
WITH RECURSIVE r AS (SELECT {_RID} FROM conversations),
p AS (
  SELECT request_id, json_array(json_object('type', 'tool_result', 'content', json_array(text, json_object('text', '[' || text, 'content', json_array(
         json_object('content', json_array(json_object('text', text || '.', 'content', '[2] ' || text), 7)))))), json_object('text', 5)) AS v FROM r),
n AS (
  SELECT request_id, v FROM p
  UNION ALL
  SELECT request_id, unnest(CASE json_type(v) WHEN 'ARRAY' THEN from_json(v, '["JSON"]') ELSE [v->'text', v->'content'] END) FROM n WHERE json_type(v) IN ('ARRAY', 'OBJECT')),
leaves AS (SELECT request_id, v->>'$' AS text FROM n WHERE json_type(v) = 'VARCHAR'),
t AS ({ORACLES["token_estimate"].replace("doc_id", "request_id").replace("documents", "leaves")})
SELECT request_id, count(*) AS texts, sum(tokens)::BIGINT AS tokens FROM t GROUP BY request_id""")
def nested_tokens(spark, sf_dir):
    """Tokens of texts within tool results within tool results, four levels deep."""
    said = lambda head, tail="": _literal(F.concat(F.lit(head), F.coalesce("text", F.lit("")), F.lit(tail)))
    parts = [F.lit('{"messages": [{"content": [{"type": "tool_result", "content": ['), said(""), F.lit(', {"text": '), said("["), F.lit(', "content": [{"content": [{"text": '), said("", "."), F.lit(', "content": '), said("[2] "), F.lit('}, 7]}]}]}, {"text": 5}]}]}')]
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.concat(*parts).alias("payload"))
    return blocks.nested_texts(rows).groupBy("request_id").agg(F.count("*").alias("texts"), F.sum(text.estimate_tokens(F.col("text")).cast("long")).alias("tokens"))


@query(r"""
WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]'), lambda x: lower(x)) AS t FROM conversations)
SELECT conv_id, turn, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM t""")
def mixed_tokens(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


_GRAMS = "CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 8 THEN [text] ELSE list_transform(range(1, length(text) - 6), lambda i: substr(text, i, 8)) END"


@query(f"SELECT conv_id, turn, len({_GRAMS})::BIGINT AS n, md5(array_to_string({_GRAMS}, '|')) AS digest FROM conversations WHERE text IS NOT NULL")
def char_grams(spark, sf_dir):
    grams = text.char_grams(F.col("text"), 8)
    return _t(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.size(grams).cast("long").alias("n"), F.md5(F.array_join(grams, "|")).alias("digest"))


@query(rf"""
WITH t AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]'), lambda x: lower(x)) AS w FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, text, CASE WHEN len(w) = 0 THEN [] ELSE {_SHINGLES} END AS s FROM t)
SELECT conv_id, turn, len(s) < 16 AS by_chars, md5(array_to_string(CASE WHEN len(s) >= 16 THEN s ELSE list_transform({_GRAMS}, lambda g: chr(1) || g) END, '|')) AS digest FROM s""")
def hybrid_shingles(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").filter("text is not null").withColumn("s", text.hybrid_shingles(F.col("text")))
    return rows.select("conv_id", "turn", (F.size(text.shingles(text.tokens(F.col("text")), 5)) < 16).alias("by_chars"), F.md5(F.array_join("s", "|")).alias("digest"))


# ---- requests and responses -----------------------------------------------------------------------------------------


@query(f"""
SELECT event_id, CASE WHEN m LIKE 'claude-3-5%' THEN 100 WHEN m LIKE 'claude-%' THEN 50 WHEN m LIKE 'gpt-4o%' THEN 70 ELSE 200000 END::INT AS tokens
FROM (SELECT event_id, ({_MODELS!r})[event_id % 6 + 1] AS m FROM events)""")
def context_windows(spark, sf_dir):
    windows = [("claude-", 50), ("gpt-4o", 70), ("claude-3-5", 100)]
    return _requests(spark, sf_dir).select("event_id", lookup.context_window(F.col("model"), windows).alias("tokens"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS at FROM events""")
def iso_times(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(18,0)") / F.lit(1_000_000)
    return _t(spark, sf_dir, "events").select("event_id", text.iso_utc(seconds).alias("at"))


@query("SELECT event_id, length(replace(props, ' ', ''))::BIGINT AS chars FROM events")
def serialised_sizes(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.serialised_chars(F.col("props")).alias("chars"))


@query("SELECT event_id, (event_type = 'error') OR event_id % 200 >= 100 AS failed FROM events")
def failed_requests(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", "broken").when(F.col("user_id") % 2 == 0, "")
    return _t(spark, sf_dir, "events").select("event_id", request_log.is_error(400 + F.col("event_id") % 200, error).alias("failed"))


@query("SELECT event_id, event_id % 3 = 0 AND user_id % 2 = 0 AND event_type <> 'error' AS cacheable FROM events")
def cacheable_requests(spark, sf_dir):
    method, path = F.when(F.col("event_id") % 3 == 0, "post").otherwise("GET"), F.when(F.col("user_id") % 2 == 0, "/v1/messages").otherwise("/v1/models")
    stream = F.when(F.col("event_type") == "error", True)
    return _t(spark, sf_dir, "events").select("event_id", cache.cacheable(method, path, stream, F.col("props")).alias("cacheable"))


@query("SELECT event_id, '<redacted>' AS hidden, event_type AS shown, ['X-Kind']::VARCHAR[] = ['X-Kind'] AS stored FROM events")
def header_rules(spark, sf_dir):
    headers = F.create_map(F.lit("Set-Cookie"), F.col("user_id").cast("string"), F.lit("X-Kind"), F.col("event_type"))
    shown, kept = cache.redacted(headers), cache.stored_headers(headers)
    return _t(spark, sf_dir, "events").select("event_id", shown["Set-Cookie"].alias("hidden"), shown["X-Kind"].alias("shown"), (F.map_keys(kept) == F.array(F.lit("X-Kind"))).alias("stored"))


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests FROM events, n
WHERE epoch(date_trunc('minute', ts)) > floor(epoch(now)) - 60 * 10080 GROUP BY 1""")
def kept_minutes(spark, sf_dir):
    out = request_log.minute_buckets(_t(spark, sf_dir, "events"), ms="value", keep_minutes=10080)
    return out.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "requests")


@query("""
SELECT user_id, greatest(0, max(event_id % 100 - 5))::BIGINT AS input_tokens, max(user_id)::BIGINT AS output_tokens, max(event_id % 7)::BIGINT AS cache_write_tokens, max(event_id % 11)::BIGINT AS cache_read_tokens
FROM events GROUP BY user_id""")
def merged_usage(spark, sf_dir):
    return usage.merged(_requests(spark, sf_dir).withColumn("user_id", F.col("output_tokens")), "user_id")


@query("""
SELECT event_id, array_to_string(list_transform(list_sort(list_filter([{'s': -greatest(0, user_id % 9 - 3), 'm': 'b'}, {'s': -greatest(0, event_id % 7 - 2), 'm': 'a'}], lambda x: x.s < 0)), lambda x: x.m), ',') AS engines FROM events""")
def engine_lists(spark, sf_dir):
    event = lambda mode, a, b: F.struct(F.lit(mode).alias("mode"), a.cast("int").alias("original_chars"), F.lit(b).alias("compressed_chars"))
    events = F.array(event("b", F.col("user_id") % 9, 3), event("a", F.col("event_id") % 7, 2))
    return _t(spark, sf_dir, "events").select("event_id", request_log.engine_list(events).alias("engines"))


@query("SELECT cache_key FROM (SELECT sha256(event_id::VARCHAR) AS cache_key, CASE WHEN user_id % 2 = 0 THEN value END AS last_hit_at, event_id FROM events) ORDER BY last_hit_at DESC NULLS LAST, event_id DESC LIMIT 200")
def kept_entries(spark, sf_dir):
    entries = _t(spark, sf_dir, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("cache_key"), F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("last_hit_at"), F.col("event_id").alias("inserted_at"))
    return cache.evicted(entries, 200).select("cache_key")


@query("""
WITH b AS (SELECT event_id % 10 >= 4 AS said, event_id % 5 >= 2 AS real, event_id % 3 = 0 AS same FROM events)
SELECT count(*) FILTER (said AND real AND same) / count(*) FILTER (said)::DOUBLE AS "precision", count(*) FILTER (said AND real AND same) / count(*) FILTER (real)::DOUBLE AS recall FROM b""")
def precision_recall(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"))
    found = rows.select("query_id", (F.col("query_id") % 3).alias("id"), (F.col("query_id") % 10 / 10).alias("sim"))
    return near_dup.precision_recall(found, rows.select("query_id", F.lit(0).alias("id"), F.when(F.col("query_id") % 5 >= 2, 0.9).otherwise(0.1).alias("sim")), 0.4)
