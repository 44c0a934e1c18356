"""Document fingerprints: a Merkle tree over sections, paragraphs and spans.

A section ends at an empty line, a paragraph at a line end, a span after SPAN code points of its paragraph. A node's
hash covers its children's hashes, so equal roots mean equal texts, and where two trees differ, the branches whose
hashes differ lead to the edits. Only DataFrame functions are used.

A fingerprint is the root (SHA-256, hex), a colon and the spans' hashes, eight hex digits each, in order.

Defined results: a null text counts as empty; an empty text has a root and no spans; rows that repeat an id and a text
have the same results; the next document of each of them but the last is the following copy; null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import saved

SPAN = 64


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def tree(text: Column, span: int = SPAN) -> Column:
    """struct<root string, sections array<struct<hash, paragraphs array<struct<hash, spans array<string>>>>>>."""

    def paragraph(p: Column) -> Column:
        pieces = F.regexp_extract_all(p, F.lit(f"(?s).{{1,{span}}}"), F.lit(0))
        spans = F.transform(pieces, lambda x: F.substring(F.sha2(x, 256), 1, 16))
        return _let(spans, lambda s: F.struct(F.sha2(F.concat(F.lit("p"), F.array_join(s, ",")), 256).alias("hash"), s.alias("spans")))

    def section(s: Column) -> Column:
        return _let(
            F.transform(F.split(s, "\n", -1), paragraph),
            lambda ps: F.struct(F.sha2(F.concat(F.lit("s"), F.array_join(F.transform(ps, lambda p: p["hash"]), ",")), 256).alias("hash"), ps.alias("paragraphs")),
        )

    return _let(
        F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section),
        lambda ss: F.struct(F.sha2(F.concat(F.lit("d"), F.array_join(F.transform(ss, lambda s: s["hash"]), ",")), 256).alias("root"), ss.alias("sections")),
    )


def spans(node: Column) -> Column:
    return F.flatten(F.transform(node["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["spans"]))))


def fingerprint(text: Column, span: int = SPAN) -> Column:
    return _let(tree(text, span), lambda t: F.concat(t["root"], F.lit(":"), F.array_join(F.transform(spans(t), lambda x: F.substring(x, 1, 8)), "")))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of distinct span hashes that two fingerprints have in common (Dice)."""
    leaves = lambda f: F.array_distinct(F.regexp_extract_all(F.substring_index(f, ":", -1), F.lit(".{8}"), F.lit(0)))
    both = F.transform(
        F.array(F.struct(leaves(a).alias("a"), leaves(b).alias("b"))),
        lambda x: F.when(F.size(x["a"]) + F.size(x["b"]) == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"]))),
    )[0]
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(both)


def changed(a: Column, b: Column) -> Column:
    """Places where tree b differs from tree a: array<struct<section, paragraph, span>>, from 0, found by going down
    only into branches whose hashes differ; paragraph or span is null where a whole branch was added or removed."""
    at = lambda s, p=None, x=None: F.struct(s.cast("int").alias("section"), (F.lit(None) if p is None else p).cast("int").alias("paragraph"), (F.lit(None) if x is None else x).cast("int").alias("span"))
    last = lambda x, y: F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    none = F.array().cast("array<struct<section:int,paragraph:int,span:int>>")

    def in_paragraph(s: Column, p: Column, x: Column, y: Column) -> Column:
        both = F.greatest(F.size(x["spans"]), F.size(y["spans"]))
        apart = lambda k: ~F.get(x["spans"], k).eqNullSafe(F.get(y["spans"], k))
        return F.when(both > 0, F.transform(F.filter(last(x["spans"], y["spans"]), apart), lambda k: at(s, p, k))).otherwise(none)

    def in_section(s: Column, x: Column, y: Column) -> Column:
        def one(p: Column) -> Column:
            u, v = F.get(x["paragraphs"], p), F.get(y["paragraphs"], p)
            return F.when(u.isNull() | v.isNull(), F.array(at(s, p))).when(u["hash"] == v["hash"], none).otherwise(in_paragraph(s, p, u, v))

        return F.flatten(F.transform(last(x["paragraphs"], y["paragraphs"]), one))

    def one(s: Column) -> Column:
        u, v = F.get(a["sections"], s), F.get(b["sections"], s)
        return F.when(u.isNull() | v.isNull(), F.array(at(s))).when(u["hash"] == v["hash"], none).otherwise(in_section(s, u, v))

    return F.when(a["root"] == b["root"], none).otherwise(F.flatten(F.transform(last(a["sections"], b["sections"]), one)))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Each document against an edited text (its last quarter replaced by the start of the next document's) and
    against the next document, in the order of ids; after the last comes the first.

    The order is found on ids alone: a range partitioning, running ids within its partitions, and a table of each
    partition's first row. Texts are shuffled once, by row key; what the previous document needs of a text, its first
    part and fingerprint, is sent on to it. No row is alone in a task, whatever the ids are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text))
    rows = docs.select(key.alias("k"), F.col(id_col).alias("doc_id"), text.alias("text"))
    ids = rows.groupBy("k", "doc_id").agg(F.count("*").alias("copies"), F.first(F.length("text")).alias("n"))
    ids = ids.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("k")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "k")
    ids = saved(ids.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33).alias("part")
    # One row for each partition that holds any: few, whatever the number of documents.
    firsts = [r["first"] for r in ids.groupBy(part).agg(F.min("at").alias("first")).orderBy("part").collect()]
    follows = docs.sparkSession.createDataFrame(list(zip(firsts, firsts[1:] + firsts[:1], strict=True)), "first long, other long")
    # at runs on without gaps within a partition, so a row whose successor doesn't exist is the partition's last.
    begun = ids.join(F.broadcast(follows), F.shiftright("at", 33) == F.shiftright("first", 33))
    ends = ids.groupBy(part).agg(F.max("at").alias("end"))
    begun = begun.join(F.broadcast(ends), F.shiftright("at", 33) == F.col("part"))
    begun = begun.select(F.struct("k", "doc_id", "copies", "n").alias("before"), F.when(F.col("at") < F.col("end"), F.col("at") + 1).otherwise(F.col("other")).alias("next_at"))
    links = begun.join(ids.select("at", "k"), F.col("next_at") == F.col("at")).select("k", "before")
    texts = rows.groupBy("k").agg(F.first("text").alias("text"))
    passed = texts.join(links, "k").select(
        F.col("before.k").alias("k"),
        F.col("before.doc_id").alias("doc_id"),
        F.col("before.copies").alias("copies"),
        F.col("before.n").alias("n"),
        F.expr("substring(text, 1, cast(floor(before.n / 4) as int))").alias("piece"),
        fingerprint(F.col("text"), span).alias("next_fingerprint"),
    )
    both = passed.join(texts, "k").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    own = F.col("copy") < F.col("copies")
    cut = "cast(floor(n / 4) as int)"
    both = both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "text",
        F.concat(F.expr(f"substring(text, 1, n - {cut})"), F.when(own, F.expr(f"substring(text, 1, {cut})")).otherwise(F.col("piece"))).alias("edited"),
        own.alias("own"),
        "next_fingerprint",
    )
    done = both.select(
        "doc_id", "n_chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"),
        F.transform(
            F.array(F.struct(fingerprint(F.col("text"), span).alias("f"), fingerprint(F.col("edited"), span).alias("e"), F.col("own").alias("own"), F.col("next_fingerprint").alias("next"))),
            lambda x: F.struct(
                x["f"].alias("f"), x["e"].alias("e"), likeness(x["f"], x["e"]).alias("near_edited"),
                F.when(x["own"], 1.0).otherwise(likeness(x["f"], x["next"])).alias("near_next"),
            ),
        )[0].alias("r"),
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256", F.col("r.f").alias("fingerprint"), F.col("r.e").alias("edited_fingerprint"),
        F.col("r.near_edited").alias("near_edited"), F.col("r.near_next").alias("near_next"),
    )
