"""Substring deduplication by seed and extend: words of repeated passages go, but for the first place of each.

A window is `length` consecutive words of one document. Of the hashes of the `seed`-word sequences in a window, the
smallest (the leftmost on ties) is the window's anchor, so equal windows have equal anchors at the same place. An anchor
is extended both ways over all windows that chose it; that stretch of words is its span. Three rounds decide:

1. Each task reduces the anchors of some megabytes of text to one row an anchor: the first of equal spans stays, the
   others are repeats over their whole spans. Rows of one anchor meet in one bucket. Where all spans are equal, all but
   the first are repeats.
2. Where the spans of an anchor differ, so that matches end within them, their windows are compared one by one.
3. Each document drops the words that repeated windows cover.

A bucket gets an anchor once from a task at most, however often it occurs there, so an anchor, line or passage that a
third of all documents hold is no hot key. The number of buckets grows with the text. Hashes have 64 bits for an anchor
and 64 more for a span or window.

Defined results: null and empty texts have no words; texts of fewer than `length` words lose none. A window starts
earlier if its doc_id is smaller (null is the largest), or it is in the same document and starts at an earlier word.
Rows with equal doc_id and equal text are one document and get equal results; texts that share a doc_id are ordered by a
hash of the text. doc_id is a whole number. Columns of other names are passed over. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.packed import joined, pack, packed_text, text_bytes
from gristmill.llm.shared import runs, saved

LENGTH = 20
SEED = 8
SLICE = 4 << 20  #: bytes of a text that are cut into words at once
WORDS = 1 << 20  #: words that a task reduces at once
KNOWN = 500_000  #: words whose hashes a task remembers
BUCKET_BYTES = 20 << 20  #: text whose anchors make a bucket
SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")

ANCHOR, COVERED, REQUEST, WINDOW = 0, 1, 2, 3
_ROW = "kind int, bucket long, doc long, print long, data binary"
_ROW_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("doc", pa.int64()), ("print", pa.int64()), ("data", pa.binary())])
_KINDS = {ANCHOR: (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64), WINDOW: (np.uint64, np.uint64, np.int64, np.int64, np.int64), COVERED: (np.int64, np.int64), REQUEST: (np.int64, np.int64)}
#: Odd factors for hashes of sequences.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


class _Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """raw in pieces of about `size` bytes that no word crosses."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw if end - at == len(raw) else raw[at:end]
        at = end


def word_hashes(raw: bytes, known: _Words) -> np.ndarray:
    parts = []
    for piece in slices(raw):
        words = piece.split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sequences:
    """Hashes of any stretch of words, from running sums."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        n = len(words)
        each = lambda b: np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b, np.uint64)))
        self.back = each(pow(base, -1, 1 << 64))
        self.sums = np.append(np.uint64(0), np.cumsum(_mix(words ^ np.uint64(base)) * each(base)[:n]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _first(new: np.ndarray) -> np.ndarray:
    """Of each row, the first of its run."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class _Pieces:
    """Words of several documents, or parts of them, in a row."""

    def __init__(self) -> None:
        self.words: list[np.ndarray] = []
        self.places: list[tuple[int, int, int]] = []  # doc, print, number of the first word
        self.total = 0

    def add(self, doc: int, text_print: int, base: int, words: np.ndarray) -> None:
        self.words.append(words)
        self.places.append((doc, text_print, base))
        self.total += len(words)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *map(len, self.words)])
        return np.concatenate(self.words), starts, np.array(self.places, np.int64)


def _anchors(pieces: _Pieces, length: int, seed: int) -> list[np.ndarray]:
    """key, span, doc, print, first window and number of windows of each anchor."""
    words, starts, places = pieces.joined()
    n = len(words) - length + 1
    at = np.arange(len(words) - seed + 1)
    keys = _Sequences(words, _BASES[0])(at, at + seed)
    best, chosen = keys[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, length - seed + 1):
        other = keys[j : j + n]
        less = other < best
        best[less] = other[less]
        chosen[less] = j
    whole = np.ones(n, bool)
    for end in starts[1:-1].tolist():
        whole[max(0, end - length + 1) : end] = False
    windows = np.flatnonzero(whole)
    anchor = windows + chosen[windows]
    new = np.flatnonzero(_changes(anchor, windows - np.arange(len(windows))))
    low, high = windows[new], windows[np.append(new[1:], len(windows)) - 1]
    anchor = anchor[new]
    span = _mix(_Sequences(words, _BASES[1])(low, high + length) ^ (anchor - low).astype(np.uint64))
    piece = np.searchsorted(starts, low, side="right") - 1
    doc, text_print, base = places[piece].T if len(piece) else np.zeros((3, 0), np.int64)
    return [keys[anchor], span, doc, text_print, low - starts[piece] + base, high - low + 1]


def _by_document(kind: int, doc: np.ndarray, text_print: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """A row of stretches (start, count) for each document."""
    order = np.lexsort((start, text_print, doc))
    doc, text_print, start, count = doc[order], text_print[order], start[order], count[order]
    for lo, hi in pairwise([*np.flatnonzero(_changes(doc, text_print)).tolist(), len(doc)]):
        yield kind, int(text_print[lo]), int(doc[lo]), int(text_print[lo]), pack(start[lo:hi], count[lo:hi])


def _by_bucket(kind: int, buckets: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    """A row of records for each bucket."""
    bucket = (columns[0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order] for c in columns], bucket[order]
    for lo, hi in pairwise([*np.flatnonzero(_changes(bucket)).tolist(), len(bucket)]):
        yield kind, int(bucket[lo]), None, None, pack(*(c[lo:hi] for c in columns))


def _compared(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Anchors sorted, each place once: the first of equal spans, what repeats one, and whether an anchor's spans
    differ (a count of 0 marks an anchor known to have different spans)."""
    key, span, doc, text_print, start, count = columns
    order = np.lexsort((start, text_print, doc, span, key))
    key, span, doc, text_print, start, count = (c[order] for c in columns)
    once = _changes(key, span, doc, text_print, start)
    key, span, doc, text_print, start, count = (c[once] for c in (key, span, doc, text_print, start, count))
    first = _changes(key, span)
    group = np.cumsum(_changes(key)) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    several = (np.bincount(group, first, groups) > 1) | (np.bincount(group, count == 0, groups) > 0)
    rows = [key, span, doc, text_print, start, count]
    return [c[first] for c in rows], [c[~first] for c in rows], several[group[first]] if groups else np.zeros(0, bool)


def _reduced(pieces: _Pieces, length: int, seed: int, buckets: int) -> Iterator[tuple]:
    first, again, several = _compared(_anchors(pieces, length, seed))
    yield from _by_document(COVERED, *again[2:])
    yield from _by_document(REQUEST, *(c[several] for c in first[2:]))
    known = np.unique(first[0][several])
    none = np.zeros(len(known), np.int64)
    yield from _by_bucket(ANCHOR, buckets, [np.append(c[~several], more) for c, more in zip(first, [known, none.astype(np.uint64), none, none, none - 1, none], strict=True)])


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= 1000 or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROW_SCHEMA, strict=True)], schema=_ROW_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROW_SCHEMA, strict=True)], schema=_ROW_SCHEMA)


def _seeds(length: int, seed: int, buckets: int):
    """Round 1 in the tasks that read the texts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        known, pieces = _Words(), _Pieces()
        for batch in batches:
            for doc, text_print, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "print", "text")), strict=True):
                base, left = 0, np.zeros(0, np.uint64)
                for part in slices((text or "").encode()):
                    left = np.concatenate([left, word_hashes(part, known)])
                    if len(left) >= WORDS:  # go on with the windows that no part has had yet
                        pieces.add(doc, text_print, base, left)
                        base += len(left) - length + 1
                        left = left[len(left) - length + 1 :]
                        yield from _reduced(pieces, length, seed, buckets)
                        pieces = _Pieces()
                if len(left) >= length:
                    pieces.add(doc, text_print, base, left)
                if pieces.total >= WORDS:
                    yield from _reduced(pieces, length, seed, buckets)
                    pieces = _Pieces()
        if pieces.total:
            yield from _reduced(pieces, length, seed, buckets)

    return lambda batches: _batches(rows(batches))


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket decided; rows of documents are passed on."""

    def rows() -> Iterator[tuple]:
        for run in runs(batches, ["kind", "bucket"]):
            kind = run.column("kind")[0].as_py()
            if kind in (COVERED, REQUEST):
                yield from zip(*(run.column(c).to_pylist() for c in run.column_names), strict=True)
                continue
            columns = joined(run.column("data").to_pylist(), *_KINDS[kind])
            if kind == ANCHOR:
                first, again, several = _compared(columns)
                several &= first[5] > 0
                yield from _by_document(COVERED, *again[2:])
                yield from _by_document(REQUEST, *(c[several] for c in first[2:]))
            else:
                doc, text_print, start = _repeated(columns)[1][2:]
                yield from _by_document(COVERED, doc, text_print, start, np.ones(len(start), np.int64))

    return _batches(rows())


def _repeated(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows sorted: the first of equal ones, and the others."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    once = _changes(*columns)
    columns = [c[once] for c in columns]
    first = _changes(*columns[:2])
    return [c[first] for c in columns], [c[~first] for c in columns]


def _windows(length: int, buckets: int):
    """Round 2: the requested windows of each document."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        known, held, size = _Words(), [], 0

        def flushed() -> Iterator[tuple]:
            first, again = _repeated([np.concatenate(c) for c in zip(*held, strict=True)])
            yield from _by_document(COVERED, *again[2:], np.ones(len(again[0]), np.int64))
            yield from _by_bucket(WINDOW, buckets, first)

        for batch in batches:
            for doc, text_print, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "print", "body", "wanted")), strict=True):
                words = word_hashes(text_bytes(text), known)
                start, count = joined(wanted, np.int64, np.int64)
                at = np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                held.append([_Sequences(words, b)(at, at + length) for b in _BASES[1:]] + [np.full(len(at), doc), np.full(len(at), text_print), at])
                size += len(at)
                if size >= WORDS:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    return lambda batches: _batches(rows(batches))


def _kept(length: int):
    """Round 3: a document's words without those that its repeated windows cover."""
    stretch = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("stretches", stretch)])

    def one(doc: int | None, raw: bytes, covered: list[bytes]) -> tuple:
        pieces = [x.split() for x in slices(raw)]
        n = sum(map(len, pieces))
        start, count = joined(covered, np.int64, np.int64)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + count + length - 1, -1)
        gone = np.cumsum(edges[:-1]) > 0
        text = b" ".join(compress(chain.from_iterable(pieces), (~gone).tolist()))
        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        lost = [{"start": a, "words": b - a} for a, b in turns.reshape(-1, 2).tolist()]
        return doc, n, int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode(), lost

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(doc, text_bytes(body), covered or []) for doc, body, covered in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "covered")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = pa.array([packed_text(x or "") for x in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), batch.column("print"), body], names=["doc_id", "doc", "print", "body"])


def _told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what rows are told apart by: doc (null as the largest number) and print."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(doc_id.isNull(), F.coalesce("text", F.lit(""))).alias("print"))


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), text (those words) and
    stretches (start and number of words of each maximal stretch that is removed) of each row of docs (doc_id, text)."""
    if not 0 < seed <= length:
        raise ValueError("seed must be between 1 and length")
    rows = _told_apart(docs)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(64, -(-size // bucket_bytes))

    def met(found: DataFrame) -> DataFrame:
        return found.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_met, _ROW)

    def of_documents(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("doc", "print").agg(F.collect_set("data").alias(name))

    bodies = rows.mapInArrow(_packed, "doc_id long, doc long, print long, body binary")
    first = saved(met(rows.select("doc", "print", "text").mapInArrow(_seeds(length, seed, buckets), _ROW)), "repeats", clean=True)
    wanted = of_documents(first.filter(F.col("kind") == REQUEST), "wanted")
    second = saved(met(bodies.join(wanted, ["doc", "print"]).select("doc", "print", "body", "wanted").mapInArrow(_windows(length, buckets), _ROW)), "repeats-windows", clean=True)
    covered = of_documents(first.filter(F.col("kind") == COVERED).unionByName(second.filter(F.col("kind") == COVERED)), "covered")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, stretches array<struct<start: long, words: long>>"
    return bodies.join(covered, ["doc", "print"], "left").select("doc_id", "body", "covered").mapInArrow(_kept(length), out)
