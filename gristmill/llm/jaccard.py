"""Prefix-tree n-gram Jaccard join, exact.

A document is its set of word shingles (64-bit hashes; equal sets are one class, so copies cost nothing). Sets are
ordered by one global order, rare shingles first: shingles that repeat within tasks are counted, the most frequent
HEAVY of them come last by count, all others by hash. Any order gives the same links; this one keeps passages that many
documents share out of the sets' beginnings. Two sets that link share one of the first n - ceil(t n) + 1 shingles of
each, so classes meet on these.

Where few classes meet, each pair whose sizes and positions leave room for the overlap is a candidate. Where more do, one
task looks at their pairs and gives only what connects them, so that rows stay in proportion to classes; a shingle of
very many classes is dealt out in pairs of blocks. Of both, only pairs stay whose sketches allow a link: a sketch holds
the parity of each of about n hash buckets, and sets differ in at least as many shingles as their sketches in bits.

Sets that candidates connect are sent to one task, each once, and are stored in a trie (see trie.py). It is walked by all
sets at once: a path's overlap is carried over to what shares it, a subtree ends where even all remaining shingles can't
reach the overlap needed, and sets that are already connected are passed over. Candidates that connect more than
GROUPED shingles are dealt out in pairs of blocks; only for those the work grows faster than the group.

Defined results: a null or empty text, or one without words, has the empty set and is linked with nothing; fewer words
than a shingle's are one shingle; repeated rows are equal sets, each with a row of its own; a null id takes part, but
isn't a component's name unless all its ids are null; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.components import components
from gristmill.llm.shared import block_pairs, row_key, runs, saved, sized, unused
from gristmill.llm.trie import Trie

WIDTH = 5
PERCENT = 75
#: Shingles that the global order puts last by their count. Bounds what each task is sent; links don't depend on it.
HEAVY = 100_000
#: Shingles that a task counts at a time.
COUNTED = 2_000_000
#: Classes that meet on a shingle of which all pairs become rows, and classes of a block where more meet.
FEW = 8
BLOCK = 2048
#: Shingles of connected candidates that one task holds.
GROUPED = 2_000_000
CACHED = 500_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_33 = np.uint64(33)


class WordHashes(dict):
    """64-bit hash of each word seen so far; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _33)) * _M[1]
    h = (h ^ (h >> _33)) * _M[2]
    return h ^ (h >> _33)


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, sorted. Words are runs of anything but ASCII white space; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - width + 1)
    h = np.full(n, min(len(ids), width), np.uint64)
    for i in range(min(len(ids), width)):
        h = _mixed(h * _M[0] + ids[i : i + n])
    return np.unique(h)


def set_id(tokens: np.ndarray) -> bytes:
    """128 bits: different sets don't meet by chance."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def short_id(whole: bytes) -> int:
    """64 bits of a set_id, for postings; classes that share them are candidates together, but are told apart after."""
    return int.from_bytes(whole[:8], "little", signed=True)


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of each of 64, 128, ... (at least as many as tokens) buckets of the tokens."""
    width = 64
    while width < len(tokens):
        width *= 2
    return np.packbits((np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows of bytes) as they are with half as many buckets."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def most_apart(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles linked sets of these sizes (sums of two) may differ in."""
    return sizes - 2 * (-(-percent * sizes // (100 + percent)))


class Order:
    """The global order of shingles."""

    def __init__(self, heavy: list[tuple[int, int]]) -> None:
        """heavy: (shingle, as a signed number, count)."""
        by = sorted((h & 0xFFFFFFFFFFFFFFFF, c) for h, c in heavy)
        self.tokens = np.array([h for h, _ in by], dtype=np.uint64)
        self.counts = np.array([c for _, c in by], dtype=np.int64)

    def sort(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return tokens
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        last = self.tokens[at] == tokens
        heavy = tokens[last]
        return np.concatenate([tokens[~last], heavy[np.lexsort((heavy, self.counts[at[last]]))]])


def most_frequent(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Tokens (token, n) by falling counts, at most `most`: all those above the smallest count for which they are so many.
    The driver gets a row for each order of magnitude (in steps of 1/16), then these tokens."""
    counts = saved(counts.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "token-counts")
    room, least = most, None
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return [] if least is None else [(r["token"], r["n"]) for r in counts.filter(F.col("step") >= least).select("token", "n").collect()]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def _int64(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64))


TOLD = pa.schema([("token", pa.int64()), ("c", pa.binary()), ("h", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("k", pa.binary()), ("bits", pa.binary())])


def describe(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """One pass over the texts. Rows with a null token: c (the set), h (its short id), n, doc_id, k (row key) and bits (the
    sketch) of each document. Others: token and n, how often it repeats among the different sets that a task counts at
    a time."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("k"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, seen, size = WordHashes(), [], set(), 0

        def repeats() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            none = {f.name: pa.nulls(len(tokens), f.type) for f in TOLD}
            return pa.RecordBatch.from_arrays([*(none | {"token": _int64(tokens), "n": pa.array(counts)}).values()], schema=TOLD)

        for b in batches:
            sets = [shingles(t, hashes, width) for t in b.column("text").to_pylist()]
            ids = [set_id(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(ids), pa.int64()), pa.array(ids, pa.binary()), pa.array(map(short_id, ids), pa.int64()), pa.array(map(len, sets), pa.int64()), b.column("doc_id"), b.column("k"), pa.array(map(sketch, sets), pa.binary())],
                schema=TOLD,
            )
            for s, c in zip(sets, ids, strict=True):
                if c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size >= COUNTED:
                yield repeats()
                held, seen, size = [], set(), 0
        if held:
            yield repeats()

    return rows.mapInArrow(run, "token long, c binary, h long, n long, doc_id long, k binary, bits binary")


def postings(docs: DataFrame, text_col: str, order: Order, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """token, h, n, at: the beginnings of the sets; copies within a batch give theirs once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = {set_id(s): s for t in b.column("text").to_pylist() if len(s := shingles(t, hashes, width))}
            if sets:
                n = np.array([len(s) for s in sets.values()])
                firsts = [order.sort(s)[: prefix_length(len(s), percent)] for s in sets.values()]
                long = np.array([len(f) for f in firsts])
                at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                h = np.repeat(np.array([short_id(c) for c in sets], dtype=np.int64), long)
                # 48 bits find who may meet; whether they link is decided on whole hashes.
                yield pa.RecordBatch.from_arrays([_int64(np.concatenate(firsts) >> np.uint64(16)), pa.array(h), pa.array(np.repeat(n, long).astype(np.int32)), pa.array(at.astype(np.int32))], names=["token", "h", "n", "at"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, h long, n int, at int")


def meetings(postings: DataFrame, percent: int = PERCENT, few: int = FEW) -> DataFrame:
    """token, h, n, partners, many, s1, s2: the classes that meet on a shingle. partners: the ones before it (by size) that
    it may link with, where at most few meet; s1 and s2 are the same for shingles on which the same classes meet.

    Windows stream a shingle's classes; only counts and the last few rows are held.
    """
    held, all_of = Window.partitionBy("token").orderBy("n", "h"), Window.partitionBy("token")
    me = F.struct("h", "n", "at")
    # First copies that several tasks have given are dropped, then shingles of a single class.
    met = postings.withColumn("lag1", F.lag(F.struct("n", "h")).over(held)).filter("lag1 is null or lag1 != struct(n, h)")
    met = met.select("token", "h", "n", "at", F.lag(me).over(held).alias("lag1"), F.lead("h").over(held).alias("next")).filter("lag1 is not null or next is not null")
    more = [F.lag(me, i).over(held).alias(f"lag{i}") for i in range(2, few)]
    signs = [F.bit_xor(F.xxhash64("h", F.lit(i))).over(all_of).alias(f"s{i}") for i in (1, 2)]
    met = met.select("token", "h", "n", "at", "lag1", *more, F.count("*").over(all_of).alias("many"), *signs)

    def may_link(y: Column) -> Column:
        room = F.least(F.col("n") - F.col("at"), y["n"] - y["at"]) * (100 + percent) >= percent * (F.col("n") + y["n"])
        return (100 * y["n"] >= percent * F.col("n")) & room

    partners = [F.when((F.col("many") <= few) & may_link(F.col(f"lag{i}")), F.col(f"lag{i}.h")) for i in range(1, few)]
    met = met.select("token", "h", "n", F.array_compact(F.array(*partners)).alias("partners"), "many", "s1", "s2")
    return met.filter((F.col("many") > few) | (F.size("partners") > 0))


def paired(met: DataFrame, classes: DataFrame, percent: int = PERCENT, few: int = FEW) -> DataFrame:
    """a, b: the candidates where few meet."""
    pairs = met.filter(F.col("many") <= few).select("h", F.explode("partners").alias("b")).select(F.least("h", "b").alias("a"), F.greatest("h", "b").alias("b")).distinct()

    @F.arrow_udf("boolean")
    def close(x: pa.Array, y: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for p, q, most in zip(x.to_pylist(), y.to_pylist(), most_apart(sizes.to_numpy(), percent).tolist(), strict=True):
            p, q = (np.frombuffer(s, np.uint8)[None] for s in sorted((p, q), key=len))
            while q.shape[1] > p.shape[1]:
                q = folded(q)
            out.append(int(np.bitwise_count(p ^ q).sum()) <= most)
        return pa.array(out, pa.bool_())

    ends = (classes.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    for end, x in zip(ends, "ab", strict=True):
        pairs = pairs.join(end, x)
    return pairs.filter(close("bitsa", "bitsb", F.col("na") + F.col("nb"))).select("a", "b")


def connected(n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """A label for each of some classes (by ascending n), equal within what candidates connect."""
    labels = np.arange(len(n))
    lengths = np.array([len(x) for x in bits])
    # Sizes of a pair are at most a factor of 100 / percent apart: sketches are of one length, or the larger's is folded.
    rows = {int(w): np.flatnonzero(lengths == w) for w in np.unique(lengths)}
    whole = {w: np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1) for w, at in rows.items()}
    place = np.zeros(len(n), np.int64)
    for at in rows.values():
        place[at] = np.arange(len(at))
    larger = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n)):
        x, kept = bits[i], int(lengths[i])
        own = np.frombuffer(x, np.uint64)
        for w in (y for y in rows if y >= kept):
            at = rows[w][np.searchsorted(rows[w], i, side="right") : np.searchsorted(rows[w], larger[i])]
            at = at[labels[at] != labels[i]]
            if not len(at):
                continue
            other = whole[w][place[at]]
            while other.shape[1] > len(own):
                half = other.shape[1] // 2
                other = other[:, :half] ^ other[:, half:]
            apart = np.bitwise_count(other ^ own).sum(1, dtype=np.int64)
            for label in np.unique(labels[at[apart <= most_apart(n[at] + n[i], percent)]]):
                labels[labels == label] = labels[i]
    return labels


def gathered(met: DataFrame, classes: DataFrame, percent: int = PERCENT, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """a, b: what connects the candidates where more meet. Shingles on which the same classes meet count once."""
    met = met.filter(F.col("many") > few)
    once = met.groupBy("s1", "s2").agg(F.min("token").alias("token")).select("token")
    rows = met.join(once, "token", "left_semi").select("token", "h", "n", "many").join(classes.select("h", "n", "bits"), ["h", "n"])
    rows = rows.select("token", block_pairs(F.col("many"), block, "h").alias("u"), "h", "n", "bits").select("token", "u.i", "u.j", "h", "n", "bits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["token", "i", "j"]):
            h = t.column("h").to_numpy()
            labels = connected(t.column("n").to_numpy().astype(np.int64), t.column("bits").to_pylist(), percent)
            tied = labels != np.arange(len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h[tied]), pa.array(h[labels[tied]])], names=["a", "b"])

    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """a, b: sets, and one that they are connected with by links. wanted: k (of a row of each set), root, i, j (the task)."""
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).alias("text")).join(sized(wanted), "k").select("text", "root", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for t in runs(batches, ["root", "i", "j"]):
            found = {}
            for chunk in t.column("text").chunks:
                for text in chunk:
                    tokens = shingles(text.as_py(), hashes, width)
                    found[set_id(tokens)] = tokens
            ids = list(found)
            labels = Trie(list(found.values()), percent).groups().tolist()
            a, b = [ids[i] for i, x in enumerate(labels) if x != i], [ids[x] for i, x in enumerate(labels) if x != i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a binary, b binary")


class Join:
    """The join of a table with itself: rows (c, n, doc_id, k) and roots (node, root) of connected classes."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, heavy: int = HEAVY, few: int = FEW, block: int = BLOCK, grouped: int = GROUPED
    ) -> None:
        told = saved(describe(docs, id_col, text_col, width), "sets-told")
        self.rows = told.filter("token is null").drop("token", "bits")
        order = Order(most_frequent(told.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")), heavy))
        # A row of each class, by which its text is found again.
        classes = told.filter("token is null and n > 0").groupBy("c").agg(F.min("k").alias("k"), F.first("h").alias("h"), F.first("n").cast("int").alias("n"), F.first("bits").alias("bits"))
        classes = saved(classes, "set-classes")
        met = saved(meetings(postings(docs, text_col, order, percent, width), percent, few), "sets-met")
        candidates = paired(met, classes, percent, few).unionByName(gathered(met, classes, percent, few, block))
        roots = saved(components(candidates), "set-candidates")
        placed = roots.join(classes.select(F.col("h").alias("node"), "c", "k", "n"), "node")
        weights = placed.groupBy("root").agg(F.sum("n").alias("weight"))
        wanted = placed.join(weights, "root").select("k", "root", block_pairs(F.col("weight"), grouped, "c").alias("u")).select("k", "root", "u.i", "u.j")
        links = linked(docs, id_col, text_col, saved(wanted, "sets-wanted"), percent, width)
        self.roots = saved(components(links), "set-roots")

    def groups(self) -> DataFrame:
        """c, g (the group), first (doc_id and k of the group's first row) of each class with shingles."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k")).alias("first")
        classes = self.rows.filter("n > 0").groupBy("c").agg(first)
        classes = classes.join(self.roots.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("root", "c"))
        return classes.select("c", "g").join(classes.groupBy("g").agg(F.min("first").alias("first")), "g")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, **settings: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    found = Join(docs, id_col, text_col, percent, width, **settings)
    empty = found.rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = found.rows.filter("n > 0").join(found.groups(), "c").select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))
    return empty.unionByName(rest)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, **settings: int) -> DataFrame:
    """The rows of docs, as they are, without all but the first (smallest id) of each group of linked documents. Of rows
    that repeat an id and a text, one stays; documents without words all stay."""
    found = Join(docs, id_col, text_col, percent, width, **settings)
    full = found.rows.filter("n > 0")
    fates = full.groupBy("k").agg(F.first("c").alias("c"), F.count("*").alias("copies")).join(found.groups(), "c")
    fates = saved(fates.select("k", (F.col("k") == F.col("first.k")).alias("stays"), "copies").filter("not stays or copies > 1"), "set-fates")
    key = unused("row_key", docs.columns)
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    gone = keyed.join(sized(fates.select(F.col("k").alias(key))), key, "left_anti")
    repeated = fates.filter("stays").select(F.col("k").alias(key))
    once = keyed.join(sized(repeated), key, "left_semi").dropDuplicates([key])
    return gone.unionByName(once).select(*docs.columns)
