"""Arrays of numbers as compressed bytes: a row of a shuffle then holds many records at about their true size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, most significant ones together, compressed."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in map(np.ascontiguousarray, arrays):
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of pack(), given their types in order."""
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    lengths = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def joined(data: Iterable[bytes], *kinds: type) -> list[np.ndarray]:
    """The arrays of many packed rows, one after the other."""
    each = [unpack(x, *kinds) for x in data]
    return [np.concatenate([np.zeros(0, k), *(x[i] for x in each)]) for i, k in enumerate(kinds)]


def packed_text(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def text_bytes(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
