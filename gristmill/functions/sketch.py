"""Sketches of texts: MinHash, SimHash, signed projections; similarities of sketches.

Two hash families, both in Arrow batches: the md5 family can be repeated in any SQL, the BLAKE2b family (functions named
*_blake2b) takes its seed as a parameter.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # less than half the time for short strings
    from _md5 import md5
except ImportError:
    from hashlib import md5


PRIME = 2_147_483_647
MULTIPLIER, STEP = 48_271, 69_621
BITS = 56
#: Lower-case ASCII letters and digits as they are, all other bytes as spaces.
SPACED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def hash28(value: Column) -> Column:
    """28 bits of the md5."""
    return F.conv(F.substring(F.md5(value), 1, 7), 16, 10).cast("long")


def _spaced(lists: pa.Array) -> Iterator[bytes]:
    """The words (runs of ASCII letters and digits) of each lower-cased text, joined by single spaces; one text at a time
    is held beside the batch."""
    for said in lists:
        yield b" ".join((said.as_py() or "").encode("utf-8", "surrogatepass").translate(SPACED).split())


def _begun(said: np.ndarray) -> np.ndarray:
    return np.append(0, np.flatnonzero(said == 32) + 1)


def _digests(said: bytes, width: int) -> np.ndarray:
    """The md5 digests of the shingles of words, a row of 16 bytes for each: shingles are parts of the joined words."""
    if not said:
        return np.zeros((0, 16), np.uint8)
    begun = _begun(np.frombuffer(said, np.uint8))
    first = begun[: max(1, len(begun) - width + 1)].tolist()
    last = (np.append(begun, len(said) + 1)[width:] - 1).tolist() or [len(said)]
    return np.frombuffer(b"".join([md5(said[i:j]).digest() for i, j in zip(first, last, strict=True)]), np.uint8).reshape(-1, 16)


def _per_words(kind: str, width: int, of: Callable[[np.ndarray], object]) -> Callable[[Column], Column]:
    """A function of the md5 digests of a text's word shingles, in Arrow batches."""

    @F.arrow_udf(kind)
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([of(_digests(said, width)) for said in _spaced(lists)])

    return lambda text: run(F.lower(text))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """The different 64-bit hashes of a text's word shingles, sorted: sums of bytes weighed by place, mixed, and of words."""

    def of(said: bytes) -> np.ndarray:
        if not said:
            return np.zeros(0, np.int64)
        points = np.frombuffer(said, np.uint8)
        begun = _begun(points)
        place = np.arange(len(points)) - np.repeat(begun, np.diff(np.append(begun, len(points) + 1)))[: len(points)]
        words = _mixed(np.add.reduceat(np.where(points == 32, np.uint64(0), points * (_mixed((place + 1).astype(np.uint64)) | np.uint64(1))), begun))
        n = min(width, len(words))
        weights = _mixed(np.arange(n + 1, 2 * n + 1, dtype=np.uint64) << np.uint64(40)) | np.uint64(1)
        sums = sum(words[j : len(words) - n + 1 + j] * weights[j] for j in range(n))
        return np.unique(_mixed(sums + np.uint64(n)).view(np.int64))

    @F.arrow_udf("array<bigint>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([of(said) for said in _spaced(lists)], pa.list_(pa.int64()))

    return run(F.lower(text))


def has_words(text: Column) -> Column:
    return F.lower(text).rlike("[a-z0-9]")


def _hashes28(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0].astype(np.int64) >> 4


def _minima(perms: int) -> Callable[[np.ndarray], np.ndarray | None]:
    p = np.arange(1, perms + 1, dtype=np.uint64)[:, None]
    times, plus, prime = p * np.uint64(MULTIPLIER) % np.uint64(PRIME), p * np.uint64(STEP), np.uint64(PRIME)

    def of(digests: np.ndarray) -> np.ndarray | None:
        hashes = np.unique(_hashes28(digests)).astype(np.uint64)
        minima = np.full(perms, prime)
        for i in range(0, len(hashes), 512):
            # 2^31 is 1 modulo the prime: the upper bits are added to the lower ones, and the sum is below twice the prime.
            x = hashes[i : i + 512] * times
            x += plus
            x = (x & prime) + (x >> np.uint64(31))
            minima = np.minimum(minima, np.minimum(x, x - prime).min(1))
        return minima.astype(np.int64) if len(hashes) else None

    return of


def minhash(text: Column, perms: int = 32, width: int = 5) -> Column:
    """Minima of (a h + b) mod 2^31 - 1 over the word shingles' hashes h; null for a text without words."""
    return _per_words("array<bigint>", width, _minima(perms))(text)


def minhash_key(text: Column, perms: int = 32, width: int = 5) -> Column:
    """16 bytes that stand for minhash(), where only equality counts; null for a text without words."""
    minima = _minima(perms)

    def of(digests: np.ndarray) -> bytes | None:
        found = minima(digests)
        return None if found is None else md5(found.tobytes()).digest()

    return _per_words("binary", width, of)(text)


def bands(signature: Column, n_bands: int, rows: int) -> Column:
    """A key for each band of the signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.array_join(F.slice(signature, b * rows + 1, rows), "-"))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions: the estimate of the Jaccard similarity; 0 for empty or unequally long signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def simhash(text: Column, width: int = 5) -> Column:
    """56-bit SimHash over the word shingles' md5: bit j is set if it is set in most of them; 0 without words."""

    def of(digests: np.ndarray) -> int:
        bits = np.unpackbits(digests[:, : BITS // 8], axis=1)
        return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(digests)).tobytes(), "big")

    return _per_words("bigint", width, of)(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column, bits: int = BITS) -> Column:
    return 1.0 - hamming(a, b) / float(bits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or unequally long vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


# ---- BLAKE2b family -------------------------------------------------------------------------------------------------


def _blake(data: bytes, person: bytes = b"") -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, person=person).digest(), "big")


def _per_list(kind: str, of: Callable[[list[str]], object]) -> Callable[[Column], Column]:
    """A function of a column of string lists, in Arrow batches."""

    @F.arrow_udf(kind)
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([of(x or []) for x in lists.to_pylist()])

    return run


def _bits(values: Iterable[int]) -> list[int]:
    """Unsigned 64-bit numbers as the signed ones with the same bits."""
    return [v - (1 << 64) if v >> 63 else v for v in values]


def minhash_blake2b(parts: Column, seed: str, perms: int = 128) -> Column:
    """MinHash of shingles: hash of seed, NUL, number (4 bytes, big endian), shingle; unsigned minima as signed bits;
    all ones without shingles."""

    def of(found: list[str]) -> list[int]:
        data = [s.encode() for s in found]
        heads = [seed.encode() + b"\x00" + struct.pack("!I", i) for i in range(perms)]
        return _bits(min((_blake(h + d) for d in data), default=(1 << 64) - 1) for h in heads)

    return _per_list("array<bigint>", of)(parts)


def minhash_personal(parts: Column, perms: int = 128) -> Column:
    """MinHash whose hashes differ by BLAKE2b's personalisation (mh0000 and on); all zeros without shingles."""

    def of(found: list[str]) -> list[int]:
        data = [s.encode("utf-8", "replace") for s in found]
        return _bits(min((_blake(d, b"mh%04d" % i) for d in data), default=0) for i in range(perms))

    return _per_list("array<bigint>", of)(parts)


def simhash_blake2b(parts: Column, seed: str) -> Column:
    def of(found: list[str]) -> int:
        head = seed.encode() + bytes(5)
        hashes = [_blake(head + s.encode()) for s in found]
        return _bits([sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))])[0]

    return _per_list("bigint", of)(parts)


def signed_projection(found: list[str], seed: str, dims: int = 512) -> list[float]:
    """Each shingle adds 1 or -1 (bit 32 of its hash) at its hash modulo dims; then unit length."""
    v = [0] * dims
    for s in found:
        h = _blake(f"{seed}\0{s}".encode())
        v[h % dims] += 1 if h >> 32 & 1 else -1
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def projection_blake2b(parts: Column, seed: str, dims: int = 512) -> Column:
    """Signed projection of shingles."""
    return _per_list("array<double>", lambda found: signed_projection(found, seed, dims))(parts)


def _signed(dims: int) -> Callable[[np.ndarray], np.ndarray]:
    def of(digests: np.ndarray) -> np.ndarray:
        hashes = _hashes28(digests)
        v = np.bincount(hashes % dims, weights=np.where(hashes // dims % 2 == 1, 1.0, -1.0), minlength=dims)
        norm = math.sqrt(float((v * v).sum()))
        return v / norm if norm > 0 else v * 0.0

    return of


def projection(text: Column, dims: int = 64, width: int = 5) -> Column:
    """Signed projection with md5 hashes."""
    return _per_words("array<double>", width, _signed(dims))(text)


def projection_and_minhash(text: Column, dims: int = 64, perms: int = 32, width: int = 5) -> Column:
    """struct v, sig of both, for which shingles are hashed once; sig is null for a text without words."""
    signed, minima = _signed(dims), _minima(perms)
    return _per_words("struct<v array<double>, sig array<bigint>>", width, lambda digests: {"v": signed(digests), "sig": minima(digests)})(text)


def pseudo_embedding(text: Column, dim: int = 3072, width: int = 4) -> Column:
    """Unit vector of hashed character runs: each adds 1 or -1 at the place that its BLAKE2b names. A text that is shorter
    than a run is filled up; null stays null; runs that cancel out give the zero vector."""
    if dim < 16 or width < 1:
        raise ValueError("dim is at least 16, width at least 1")

    def one(said: str) -> list[float]:
        said = said.ljust(width, "\0")
        out = np.zeros(dim)
        for run, count in Counter(said[i : i + width] for i in range(len(said) - width + 1)).items():
            digest = hashlib.blake2b(run.encode("utf-8", "replace"), digest_size=8).digest()
            out[int.from_bytes(digest[:4], "big") % dim] += count if digest[4] & 1 else -count
        length = np.sqrt(out @ out)
        return (out / length if length else out).tolist()

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return of(text)
