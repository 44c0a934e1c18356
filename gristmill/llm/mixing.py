"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. Where sets overlap, their totals reach the driver, where a
small flow network sends each pattern's words to the quotas of its sources; a source that shares no document needs none. The first use of a word costs 0, the second 1, the
third 2 (convex), so nothing is repeated while unused words are left. Documents are then taken in a seeded order: all
of a pattern's documents as often as its flow holds the pattern whole, and a seeded part once more; the document at
the boundary is cut, so that the words taken are exactly the flow.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in the
order; rows with a null id or repeated ids count as documents of their own; an empty table gives an empty mix. Only
the named columns are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.llm.shared import saved, sized
from gristmill.operators.sequences import running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hex digits of the seeded order that are aggregated before documents are looked at one by one.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_shares(sizes: Sequence[int], weights: Sequence[int], total: int, max_repeats: int = MAX_REPEATS) -> list[Fraction]:
    """total shared by weight, none above max_repeats times its size; the excess is shared again among the others."""
    targets = [Fraction(0)] * len(sizes)
    left, rest = Fraction(total), set(range(len(sizes)))
    while rest:
        unit = left / sum(weights[i] for i in rest)
        full = [i for i in rest if unit * weights[i] >= max_repeats * sizes[i]]
        for i in full or rest:
            targets[i] = Fraction(max_repeats * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        rest -= set(full)
        left -= sum(targets[i] for i in full)
    return targets


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], max_repeats: int = MAX_REPEATS) -> list[list[int]]:
    """Min-cost flow from patterns (sources they belong to, words) to quotas: flow[pattern][source].

    Successive cheapest augmenting paths; the cost of a pattern's next word is how often it has been used whole. Paths
    are searched in the bipartite graph of patterns and sources, whose size is that of the totals, not of the data.
    """
    flow = [[0] * len(quotas) for _ in patterns]
    used = [0] * len(patterns)
    open_quota = list(quotas)
    for level in range(max_repeats):
        room = [words * (level + 1) - u for (_, words), u in zip(patterns, used, strict=True)]
        while True:
            # A path starts at a pattern with room at this level, and may move words already routed to another source.
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", i): None for i, r in enumerate(room) if r > 0}
            queue, end = list(came), None
            for kind, i in queue:
                if kind == "p":
                    after = [("s", s) for s in patterns[i][0]]
                elif open_quota[i] > 0:
                    end = (kind, i)
                    break
                else:
                    after = [("p", p) for p in range(len(patterns)) if flow[p][i] > 0]
                for node in after:
                    if node not in came:
                        came[node] = (kind, i)
                        queue.append(node)
            if end is None:
                break
            path = [end]
            while (before := came[path[-1]]) is not None:
                path.append(before)
            path.reverse()
            steps = list(zip(path, path[1:], strict=False))
            amount = min([room[path[0][1]], open_quota[end[1]], *(flow[b[1]][a[1]] for a, b in steps if a[0] == "s")])
            for a, b in steps:
                if a[0] == "p":
                    flow[a[1]][b[1]] += amount
                else:
                    flow[b[1]][a[1]] -= amount
            room[path[0][1]] -= amount
            used[path[0][1]] += amount
            open_quota[end[1]] -= amount
    return flow


def _quotas(members: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """source, source_size, target and quota (whole words) of each source, as target_shares has them: in order of size by
    weight, those whose share is above their limit are a first part, found by running sums."""
    number = lambda c: c.cast("decimal(38,0)")
    sizes = members.select(F.explode("sources").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = running_sums(sizes.withColumn("one", F.lit(1)), {"rank": "one"}, [F.asc_nulls_last("source")])
    weight = number(F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1).cast("int") % len(weights) + 1))
    ranked = ranked.withColumn("weight", weight).withColumn("most", number(F.col("source_size") * max_repeats))
    # Times a common multiple of the weights, size by weight is a whole number.
    ranked = ranked.withColumn("by_weight", number(F.col("most") * lcm(*weights) / F.col("weight")))
    upto = running_sums(ranked, {"most_upto": "most", "weight_upto": "weight"}, ["by_weight", F.asc_nulls_last("source")])
    total = F.lit(members.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]).cast("decimal(38,0)")
    every = F.lit(ranked.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]).cast("decimal(38,0)")
    left, weights_left = total - F.col("most_upto") + F.col("most"), every - F.col("weight_upto") + F.col("weight")
    judged = saved(upto.withColumn("full", number(left) * F.col("weight") >= F.col("most") * number(weights_left)), "mix-sources")
    full, open_weight = judged.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(1))).first()
    share = number((total - F.lit(full).cast("decimal(38,0)"))) * F.col("weight")
    rest = F.lit(open_weight).cast("decimal(38,0)")
    return judged.select(
        "source", "source_size",
        F.round(F.when(F.col("full"), F.col("most").cast("double")).otherwise(number(share).cast("double") / rest.cast("double")), 6).alias("target"),
        F.when(F.col("full"), F.col("most")).otherwise(number((share - share % rest) / rest)).cast("long").alias("quota"),
    )


def _plan(patterns: DataFrame, weights: Sequence[int], max_repeats: int, max_patterns: int) -> DataFrame:
    """pattern, source_size, target, whole and rest. A source whose documents belong to it alone fills its own quota;
    patterns that share sources, and these sources' own, are routed on the driver."""
    spark = patterns.sparkSession
    members = patterns.select("pattern", "words", F.from_json("pattern", "array<string>").alias("sources"))
    quotas = saved(_quotas(members, weights, max_repeats), "mix-quotas")
    shared = members.filter(F.size("sources") > 1)
    touched = shared.select(F.explode("sources").alias("source")).distinct().withColumnRenamed("source", "touched")
    alone = members.filter(F.size("sources") == 1).select("pattern", "words", F.col("sources")[0].alias("own"))
    meets = F.col("own").eqNullSafe(F.col("touched"))
    plain = alone.join(touched, meets, "left_anti").join(quotas, F.col("own").eqNullSafe(F.col("source")))
    some = F.col("words") > 0
    out = plain.select("pattern", "source_size", "target", F.when(some, F.expr("quota div words")).otherwise(0).cast("long").alias("whole"), F.when(some, F.col("quota") % F.col("words")).otherwise(0).cast("long").alias("rest"))
    tangled = shared.unionByName(alone.join(touched, meets, "left_semi").select("pattern", "words", F.array("own").alias("sources"))).limit(max_patterns + 1).collect()
    if len(tangled) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns overlap")
    if not tangled:
        return out
    known = quotas.join(touched, F.col("source").eqNullSafe(F.col("touched")), "left_semi").collect()
    place = {r["source"]: i for i, r in enumerate(known)}
    flow = route([([place[s] for s in r["sources"]], r["words"]) for r in tangled], [r["quota"] for r in known], max_repeats)
    rows = []
    for r, f in zip(tangled, flow, strict=True):
        first = known[place[r["sources"][0]]]
        rows.append((r["pattern"], first["source_size"], first["target"], *(divmod(sum(f), r["words"]) if r["words"] else (0, 0))))
    return out.unionByName(spark.createDataFrame(rows, out.schema))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
    keep: bool = False,
    max_patterns: int = 20_000,
) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, whole (times it is taken whole), cut (words of
    a further, cut copy); with keep also kept, a struct of all columns of docs.

    source_col may hold a string or an array of strings (overlapping sources). Sources in code point order, null
    last, have the weights, repeated; the words of all documents are shared by weight, up to max_repeats times a
    source's size. source_size and target are those of the document's first source. Sources may be many; more than
    max_patterns sets of sources that overlap with others are an error, as their totals go to the driver.
    """
    held = F.col(source_col)
    if not isinstance(docs.schema[source_col].dataType, T.ArrayType):
        held = F.array(held.cast("string"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        word_count(F.col(text_col)).alias("size"),
        F.to_json(F.array_sort(F.array_distinct(F.when(F.size(held) > 0, held).otherwise(F.array(F.lit(None).cast("string")))))).alias("pattern"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("draw"),
        F.struct(*(F.col(c) for c in docs.columns)).alias("kept"),
    )
    lean = saved(rows.drop("kept"), "mix-sizes")
    plan = sized(saved(_plan(saved(lean.groupBy("pattern").agg(F.sum("size").alias("words")), "mix-patterns"), weights, max_repeats, max_patterns), "mix-plan"))

    # The seeded order is walked in two steps: totals of its buckets, then only the documents of the boundary bucket.
    bucket = F.substring("draw", 1, BUCKET_DIGITS)
    order = Window.partitionBy("pattern").orderBy("bucket")
    steps = lean.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    steps = steps.withColumn("upto", F.sum("words").over(order)).join(plan.select("pattern", "rest"), "pattern")
    boundary = steps.filter((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    boundary = boundary.groupBy("pattern").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("at"))
    boundary = sized(saved(boundary.select("pattern", F.col("at.bucket").alias("last_bucket"), F.col("at.left").alias("left")), "mix-boundary"))
    rows = (rows if keep else lean).join(plan, "pattern").join(boundary, "pattern", "left").withColumn("bucket", bucket)
    # No boundary: the rest is 0 (or the pattern has no words), so nothing more is taken.
    sure = rows.filter(F.col("last_bucket").isNull() | (F.col("bucket") != F.col("last_bucket")))
    sure = sure.withColumn("more", F.when(F.col("bucket") < F.col("last_bucket"), F.col("size")).otherwise(0))
    edge = rows.filter(F.col("bucket") == F.col("last_bucket"))
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(before, F.lit(0)))))
    out = sure.unionByName(edge)
    full = (F.col("more") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + F.col("more")).alias("taken"),
        (F.col("whole") + F.when(full, 1).otherwise(0)).alias("whole"),
        F.when(full, 0).otherwise(F.col("more")).cast("long").alias("cut"),
        *(["kept"] if keep else []),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of docs as often as the mix takes them; the text of a further, cut copy ends after its last word.
    Documents without words are in no mix."""
    out = mix(docs, id_col, text_col, source_col, keep=True, **settings)
    copies = F.col("whole") + F.when(F.col("cut") > 0, 1).otherwise(0)
    out = out.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    words = F.regexp_extract_all(F.col("kept")[text_col], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("copy") > F.col("whole"), F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), "")).otherwise(F.col("kept")[text_col])
    return out.select(*(text.alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns))

