"""The words of a batch of texts, cut at bytes of a class, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PASS_BYTES = 1 << 18  # texts that are worked on at once, so that tables of their words stay small; a longer one is alone


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256: is the byte in one of the ranges, ends included?"""
    out = np.zeros(256, bool)
    for a, z in ranges:
        out[a:z + 1] = True
    return out


WHITE = byte_class((0x20, 0x20), (0x09, 0x0D))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of binaries without nulls, and where each of them begins (and the last ends)."""
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begins = np.frombuffer(at, wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[begins[0]:begins[-1]], begins - begins[0]


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that have ``limit`` bytes together at most, or are one."""
    _, begins = bytes_of(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_starts(inside: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which bytes begin a run of bytes that are ``inside``; a run ends with its text."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = begins[:-1][begins[:-1] < begins[1:]]
    first[heads] = inside[heads]
    return first


def cut(data: np.ndarray, inside: np.ndarray, first: np.ndarray) -> pa.Array:
    """The runs of bytes that are ``inside`` as binaries, in their order."""
    kept = np.ascontiguousarray(data[inside])
    at = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(kept)])


def codes_of(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The values' numbers in order of first sight, and the distinct values."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct whole numbers, and how often each is there, by hashing."""
    out = pa.array(keys).value_counts()
    return out.field(0).to_numpy(), out.field(1).to_numpy()
