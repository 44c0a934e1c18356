"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation is the one whose pieces' scores, as the model file gives them, have the largest sum. Positions are
read one by one; a piece that ends at the next position starts at most the longest piece's length before it, so only
that window of positions is live. Whenever the backpointer paths of all live positions run through one boundary, the
ids up to it are committed and forgotten. No piece goes on after a space that follows other characters, nor over a
line feed; there all paths meet, so a text falls into chunks, and a chunk seen before needs no search.

A space is written as U+2581, and one is put before the text (decoding takes it off again). Characters that no piece
covers, U+2581 itself among them, become byte pieces. Ties go to the longer last piece. The model has BPE merge ranks
for scores, so ids may differ from those of a BPE merge; decoding gives the exact text back.

Defined results: a null or empty text has no ids, and no ids decode to an empty text; repeated rows and null ids are
rows like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
CACHED = 600_000  #: chunks whose ids a task remembers
LONGEST_CACHED = 40
UNREACHED = float("-inf")


class Vocabulary(NamedTuple):
    pieces: dict[str, tuple[float, int]]  #: piece -> (score, id)
    bytes_at: int  #: id of the byte piece 0; the others follow
    texts: list[bytes]  #: what each id stands for


def load(model_file: str = MODEL) -> Vocabulary:
    """The normal pieces of a model file with byte fallback, read on the driver; tasks get them with their function."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, texts, bytes_at = {}, [], None
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            if bytes_at is None:
                bytes_at = i
            texts.append(bytes([i - bytes_at]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} goes over a chunk boundary")
            pieces[piece] = (model.get_score(i), i)
            texts.append(piece.replace(SPACE, " ").encode())
    if bytes_at is None:
        raise ValueError("the model has no byte pieces")
    return Vocabulary(pieces, bytes_at, texts)


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.prefixes: dict[str, tuple[int, int] | None] = {p[:k]: None for p in vocabulary.pieces for k in range(1, len(p))} | vocabulary.pieces
        self.window = max(map(len, vocabulary.pieces))
        self.bytes_at = vocabulary.bytes_at
        self.fallback = min(s for s, _ in vocabulary.pieces.values()) - 10  # score of a character written in bytes
        self.pairs = {p[k : k + 2] for p in vocabulary.pieces for k in range(len(p) - 1)}  # neighbours within a piece
        self.cache: dict[str, tuple[int, ...]] = {}

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of the characters, given in order and never held beyond what isn't committed."""
        held = ""  # characters after the last committed boundary
        done = 0  # positions of held from which pieces have been tried
        best: list[float] = [0]
        back: list[tuple[int, int]] = [(0, -1)]  # start of the best piece that ends here, its id (-1: bytes)
        chars = iter(chars)
        while more := "".join(x for _, x in zip(range(2 * self.window), chars, strict=False)):
            held += more
            best += [UNREACHED] * len(more)
            back += [(0, -1)] * len(more)
            if (upto := len(held) - self.window) > done:  # pieces from there may still grow
                self._extend(held, best, back, done, upto)
                done = upto
                if at := self._meeting(back, best, done):
                    yield from self._ids(held, back, at)
                    held, best, back, done = held[at:], best[at:], [(max(0, s - at), i) for s, i in back[at:]], done - at
        self._extend(held, best, back, done, len(held))
        yield from self._ids(held, back, len(held))

    def _search(self, text: str) -> list[int]:
        """What stream gives for a text that fits its first window."""
        best, back = [0, *[UNREACHED] * len(text)], [(0, -1)] * (len(text) + 1)
        self._extend(text, best, back, 0, len(text))
        return self._ids(text, back, len(text))

    def _extend(self, held: str, best: list[float], back: list[tuple[int, int]], begin: int, end: int) -> None:
        """Tries all pieces that start from begin to end (without it)."""
        known, window, fallback, n = self.prefixes.get, self.window, self.fallback, len(held) + 1
        for start in range(begin, end):
            score = best[start]
            if score + fallback > best[start + 1]:
                best[start + 1], back[start + 1] = score + fallback, (start, -1)
            for stop in range(start + 1, min(start + window + 1, n)):
                if x := known(held[start:stop], 0):
                    if score + x[0] > best[stop]:
                        best[stop], back[stop] = score + x[0], (start, x[1])
                elif x == 0:  # no piece begins like this
                    break

    def _meeting(self, back: list[tuple[int, int]], best: list[float], done: int) -> int:
        """The last boundary on the paths of all live positions: done, and those beyond that a piece has reached."""
        live = {e for e in range(done, min(done + self.window, len(back))) if best[e] > UNREACHED}
        while len(live) > 1:
            far = max(live)
            live = (live - {far}) | {back[far][0]}
        return live.pop()

    def _ids(self, held: str, back: list[tuple[int, int]], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            start, piece = back[end]
            out += [piece] if piece >= 0 else [self.bytes_at + b for b in reversed(held[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        out.reverse()
        return out

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a chunk that isn't remembered: cut where no piece goes over, the parts are searched or remembered."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs]
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]
        ids: tuple[int, ...] = ()
        for part in parts if len(parts) < 20 else ["".join(parts)]:
            if (found := self.cache.get(part)) is None:
                found = self._remember(part, tuple(self.stream(part) if len(part) > 2 * self.window else self._search(part)))
            ids += found
        return self._remember(text, ids)

    def _remember(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= LONGEST_CACHED:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        get, chunk = self.cache.get, self.chunk
        parts = text.split(SPACE)
        out = [get(c) or chunk(c) for c in CHUNK.findall(f" {parts[0]}".replace(" ", SPACE))]
        for part in parts[1:]:
            out.append(tuple(self.bytes_at + b for b in SPACE.encode()))
            out += [get(c) or chunk(c) for c in CHUNK.findall(part.replace(" ", SPACE))]
        return np.fromiter(chain.from_iterable(out), dtype=np.int32)


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.texts = vocabulary.texts

    def decode(self, ids: Iterable[int]) -> str:
        """The text; ids outside the vocabulary raise an error, bytes that are no text become U+FFFD."""
        return b"".join(map(self.texts.__getitem__, ids))[1:].decode("utf-8", "replace")


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    made: list[Encoder] = []

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Encoder(vocabulary))
        return _lists([made[0].encode(t or "") for t in texts.to_pylist()])

    return of(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        return pa.array([Decoder(vocabulary).decode(x or ()) for x in lists.to_pylist()], pa.string())

    return of(ids)


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and exact (the decoded ids are the text) for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = [encoder.encode(t) for t in texts]
            exact = [decoder.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, _lists(ids), pa.array(exact)], names=["doc_id", "n_tokens", "ids", "exact"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, exact boolean")
