"""Alignment of two tokenizers over the same bytes, with every distinct segment of the corpus tokenised once.

A is a byte-level BPE, B a SentencePiece BPE; both read a space and the text. Texts are cut into segments before runs of
white space that follow another character. `verified_cuts` proves from both vocabularies that no token goes over such a
cut; A's word pattern and B's merges then give a segment the same tokens alone as within its text.

1. Each task gives the segments of some megabytes of text (a chunk) numbers, the most frequent the smallest, and writes
   the documents as numbers and the chunk's segments by bucket of their hash.
2. A bucket gets its segments from all chunks and tokenises and aligns each of them once; each chunk gets the alignments
   of its segments back.
3. Documents are composed of segments, once to count in how many documents each pair of ids is linked, and again, when
   each chunk has the counts of its pairs, for the result.

A segment or pair comes from a chunk once, however often it occurs there, so none is a hot key. A task holds a chunk's
segments, or the distinct segments of one of BUCKETS buckets.

Defined results: null and empty texts, and texts whose tokens' bytes are not a space and the text (a text that holds
U+2581), have no tokens: zeros and an empty groups_sha256, and they count for no pair. Repeated rows are documents of
their own; null ids are ids like others. Columns of other names are passed over. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.packed import pack, packed_text, text_bytes, unpack
from gristmill.llm.shared import saved

BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32 << 20  #: characters of text whose segments are numbered together
BUCKETS = 4096
SLICE = 1 << 20  #: characters of a text that are cut at once
TURN = 1 << 16  #: segments of a document that are composed at once
SPACE = "▁"
WHITE = " \t\n\x0b\x0c\r"

ALIGNED, COUNTS, DOCUMENT = 0, 1, 2
_PAIRS = (np.uint32, np.int32, np.int32, np.int32, np.int32, np.uint64)  # places; pairs (-1: bytes differ), A ids, B ids and groups of each; pairs


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is visible, else the next from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, read on the driver and opened again in each worker."""

    def __init__(self, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> None:
        with open(byte_file, encoding="utf-8") as f:
            self.bytes_json = f.read()
        with open(piece_file, "rb") as f:
            self.piece_model = f.read()
        made = json.loads(self.bytes_json)
        plain = made["normalizer"] is None and made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        spec = self._proto.normalizer_spec
        if not plain or made["model"]["type"] != "BPE" or self._proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("segments can only be cut for a byte-level BPE with its usual words and a SentencePiece BPE that keeps the text")
        self.cuts = verified_cuts(self.bytes_a, self.bytes_b)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("bytes_json", "piece_model", "cuts")}

    @cached_property
    def _proto(self):
        from sentencepiece import sentencepiece_model_pb2

        out = sentencepiece_model_pb2.ModelProto()
        out.ParseFromString(self.piece_model)
        return out

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.bytes_json)
        out.encode_special_tokens = True
        return out

    @cached_property
    def b(self):
        """The model without the space that it would put before each segment."""
        import sentencepiece

        self._proto.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=self._proto.SerializeToString())

    @cached_property
    def bytes_a(self) -> list[bytes]:
        letters, vocabulary = _byte_letters(), self.a.get_vocab(with_added_tokens=False)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # A special token, whose letters may stand for no bytes, never comes out of a text.
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        return [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(SPACE, " ").encode() for p in self._proto.pieces]

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of a space and the text, some at a time."""
        inner = re.escape(self.cuts)
        one = re.compile(rf"[{inner}]\s*\S*(?:(?![{inner}])\s+\S*)*")
        cut = re.compile(rf"(?<=\S)(?=[{inner}])")
        text, at = " " + text, 0
        while at < len(text):
            found = cut.search(text, at + SLICE)
            end = found.start() if found else len(text)
            yield one.findall(text[at:end] if at or found else text)
            at = end

    def align(self, segments: list[str]) -> list[tuple[str, np.ndarray, int, int, int] | None]:
        """Of each segment: groups as text, linked pairs (A id in the upper half), and numbers of A ids, B ids and
        groups; None where the bytes of the tokens aren't those of the segment."""
        each_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        each_b = self.b.encode(segments, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = [b"".join(map(of_a, x)) == (raw := s.encode()) == b"".join(map(of_b, y)) and bool(raw) for s, x, y in zip(segments, each_a, each_b, strict=True)]
        each_a, each_b = ([x for x, g in zip(e, good, strict=True) if g] for e in (each_a, each_b))
        a, b = (np.array([i for x in e for i in x], np.int64) for e in (each_a, each_b))
        end_a, end_b = (np.cumsum(np.array([len(of(i)) for i in x.tolist()], np.int64)) for of, x in ((of_a, a), (of_b, b)))
        ends = np.union1d(end_a, end_b)  # the bytes between two ends belong to one token of each
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs = (a[at_a].astype(np.uint64) << np.uint64(32)) | b[at_b].astype(np.uint64)
        shared = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        cut_a, cut_b = np.append(0, at_a[shared] + 1).tolist(), np.append(0, at_b[shared] + 1).tolist()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)]
        n_a, n_b = [len(x) for x in each_a], [len(x) for x in each_b]
        last = end_a[np.cumsum(n_a, dtype=np.int64) - 1] if n_a else np.zeros(0, np.int64)
        to_pair = np.searchsorted(ends, last, side="right").tolist()
        to_group = np.searchsorted(ends[shared], last, side="right").tolist()
        found, p, g = [], 0, 0
        for x, y, q, h in zip(n_a, n_b, to_pair, to_group, strict=True):
            found.append((";".join(groups[g:h]), pairs[p:q], x, y, h - g))
            p, g = q, h
        left = iter(found)
        return [next(left) if ok else None for ok in good]


def verified_cuts(tokens: Iterable[bytes], pieces: Iterable[bytes]) -> str:
    """The white space before which no token of either vocabulary goes on after another character: in no token does it
    follow anything but white space. Broken characters count as others."""
    bad: set[str] = set()
    for token in (*tokens, *pieces):
        text = token.decode(errors="replace")
        bad.update(y for x, y in pairwise(text) if y in WHITE and not x.isspace())
    if " " in bad:
        raise ValueError("the vocabularies have tokens that go over a space")
    return "".join(c for c in WHITE if c not in bad)


class _Numbers(dict):
    """segment -> number, in order of first use."""

    def __missing__(self, segment: str) -> int:
        found = self[segment] = len(self)
        return found


_CHUNKED = "chunk long, kind int, bucket int, doc_id long, data binary, body binary"
_CHUNKED_SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("data", pa.binary()), ("body", pa.binary())])


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= 2000 or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _numbered(tools: Tokenizers, chunk_size: int):
    """Documents as numbers of segments, and the segments of each chunk by bucket."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        numbers, held, size = _Numbers(), [], 0
        chunk = TaskContext.get().partitionId() << 32

        def flushed() -> Iterator[tuple]:
            count = np.zeros(len(numbers), np.int64)
            for _, seq in held:
                count += np.bincount(seq, minlength=len(count))
            rank = np.empty(len(count), np.uint32)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
            for doc_id, seq in held:
                yield chunk, DOCUMENT, None, doc_id, pack(rank[seq]), None
            segments = list(numbers)
            bucket = np.fromiter((zlib.crc32(s.encode()) % BUCKETS for s in segments), np.int64, len(segments))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                texts = [segments[i] for i in own.tolist()]
                yield chunk, ALIGNED, b, None, pack(rank[own], np.array([len(t) for t in texts], np.uint32)), packed_text("".join(texts))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = [np.fromiter(map(numbers.__getitem__, s), np.int32, len(s)) for s in tools.segments(text)] if text else []
                held.append((doc_id, np.concatenate([np.zeros(0, np.int32), *parts])))
                size += len(text or "")
                if size >= chunk_size:
                    yield from flushed()
                    numbers, held, size, chunk = _Numbers(), [], 0, chunk + 1
        yield from flushed()

    return lambda batches: _batches(rows(batches), _CHUNKED_SCHEMA)


def _aligned(tools: Tokenizers):
    """For each row of segments, their alignments; rows come by bucket."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        known: dict[str, tuple | None] = {}
        before = None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if buckets[lo] != before:
                    known, before = {}, buckets[lo]
                part = batch.slice(lo, hi - lo)
                asked = []
                for data, body in zip(part.column("data").to_pylist(), part.column("body").to_pylist(), strict=True):
                    places, lengths = unpack(data, np.uint32, np.uint32)
                    body = text_bytes(body).decode()
                    ends = np.cumsum(lengths, dtype=np.int64).tolist()
                    asked.append((places, [body[i:j] for i, j in zip([0, *ends], ends, strict=False)]))
                new = list(dict.fromkeys(s for _, own in asked for s in own if s not in known))
                known.update(zip(new, tools.align(new), strict=True) if new else ())
                for chunk, (places, own) in zip(part.column("chunk").to_pylist(), asked, strict=True):
                    found = [known[s] for s in own]
                    counts = np.array([(len(x[1]), *x[2:]) if x else (-1, 0, 0, 0) for x in found], np.int32).reshape(-1, 4).T
                    pairs = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in found if x)])
                    yield chunk, ALIGNED, None, None, pack(places, *counts, pairs), packed_text("\n".join(x[0] if x else "" for x in found))

    return lambda batches: _batches(rows(batches), _CHUNKED_SCHEMA)


class _Chunk:
    """The alignments of a chunk's segments, by their number."""

    def __init__(self, rows: list[tuple[bytes, bytes | None]]) -> None:
        each = [unpack(data, *_PAIRS) for data, _ in rows]
        places, n_pairs, n_a, n_b, n_groups, pairs = (np.concatenate([np.zeros(0, k), *(x[i] for x in each)]) for i, k in enumerate(_PAIRS))
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        order = np.empty(len(places), np.int64)
        order[places] = np.arange(len(places))
        size = np.maximum(n_pairs, 0)
        ends = np.cumsum(size)
        self.size, self.start = size[order], (ends - size)[order]
        self.bad, self.n_a, self.n_b, self.n_groups = (n_pairs < 0)[order], n_a[order], n_b[order], n_groups[order]
        self.order = order
        self.rows = rows

    @cached_property
    def texts(self) -> np.ndarray:
        found = [t for _, body in self.rows for t in text_bytes(body).decode().split("\n")]
        return np.array(found, object)[self.order]

    def per_segment(self, of_pair: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(of_pair[self.pair]))
        return sums[self.start + self.size] - sums[self.start]

    def pairs_of(self, segments: np.ndarray) -> np.ndarray:
        size = self.size[segments]
        ends = np.cumsum(size)
        return np.unique(self.pair[np.repeat(self.start[segments] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])


def _by_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """chunk, kind and rows of runs of both; the rows come sorted."""
    for batch in batches:
        chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
        if len(chunk):
            edges = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield int(chunk[lo]), int(kind[lo]), batch.slice(lo, hi - lo)


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each chunk each pair of ids is linked."""
    held: list = []
    at, now, docs = None, None, None

    def counted() -> pa.RecordBatch:
        some = docs > 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), at, np.int64)), pa.array(now.pairs[some].astype(np.int64)), pa.array(docs[some])], names=["chunk", "pair", "docs"])

    for chunk, kind, rows in _by_chunk(batches):
        if chunk != at:
            if now is not None:
                yield counted()
            held, at, now = [], chunk, None
        data = rows.column("data").to_pylist()
        if kind == ALIGNED:
            held += zip(data, [None] * len(data), strict=True)
            continue
        if now is None:
            now = _Chunk(held)
            docs = np.zeros(len(now.pairs), np.int64)
        for x in data:
            segments = np.unique(unpack(x, np.uint32)[0])
            if not now.bad[segments].any():
                docs[now.pairs_of(segments)] += 1
    if now is not None:
        yield counted()


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
_RESULT_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string()), ("groups", pa.string())])


def _composed(keep: bool):
    """The result's rows, from a chunk's alignments, the counts of its pairs and its documents, in this order."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held, counts, at, now = [], [], None, None
        for chunk, kind, part in _by_chunk(batches):
            if chunk != at:
                held, counts, at, now = [], [], chunk, None
            if kind == ALIGNED:
                held += zip(part.column("data").to_pylist(), part.column("body").to_pylist(), strict=True)
                continue
            if kind == COUNTS:
                counts.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
                continue
            if now is None:
                now = _Chunk(held)
                pair, n, best = (np.concatenate(c) for c in zip(*counts, strict=True)) if counts else (np.zeros(0, np.int64),) * 3
                place = np.searchsorted(now.pairs, pair.astype(np.uint64))
                of_pair = np.zeros((2, len(now.pairs)), np.int64)
                of_pair[0, place], of_pair[1, place] = n, best
                total, top = now.per_segment(of_pair[0]), now.per_segment(of_pair[1])
            for doc_id, data in zip(part.column("doc_id").to_pylist(), part.column("data").to_pylist(), strict=True):
                seq = unpack(data, np.uint32)[0]
                if not len(seq) or now.bad[seq].any():
                    yield doc_id, 0, 0, 0, 0, 0, 0, "", "" if keep else None
                    continue
                sha, kept = hashlib.sha256(), []
                for lo in range(0, len(seq), TURN):
                    text = (";" if lo else "") + ";".join(now.texts[seq[lo : lo + TURN]].tolist())
                    sha.update(text.encode())
                    if keep:
                        kept.append(text)
                sums = (int(x[seq].sum()) for x in (now.n_a, now.n_b, now.n_groups, now.size, top, total))
                yield doc_id, *sums, sha.hexdigest(), "".join(kept) if keep else None

    return lambda batches: _batches(rows(batches), _RESULT_SCHEMA)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents), best (whether n is the A id's highest) from the chunks' counts."""
    counts = found.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, tools: Tokenizers | None = None, groups: bool = False, chunk_size: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups (else null) of
    each row of docs (doc_id, text)."""
    tools = tools or Tokenizers()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = saved(rows.mapInArrow(_numbered(tools, chunk_size), _CHUNKED), "align-chunks", clean=True)
    asked = chunks.filter(F.col("kind") == ALIGNED).select("bucket", "chunk", "data", "body")
    aligned = saved(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_aligned(tools), _CHUNKED), "align-segments", clean=True).select("chunk", "kind", "doc_id", "data", "body")
    documents = chunks.filter(F.col("kind") == DOCUMENT).select("chunk", "kind", "doc_id", "data", "body")
    together = aligned.select("chunk", "kind", "data").unionByName(documents.select("chunk", "kind", "data"))
    linked = saved(together.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_linked, "chunk long, pair long, docs long"), "align-pairs", clean=True)
    counts = linked.select("chunk", "pair").join(pair_counts(linked), "pair").withColumn("kind", F.lit(COUNTS))
    every = aligned.unionByName(documents).unionByName(counts, allowMissingColumns=True)
    return every.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_composed(groups), _RESULT)
