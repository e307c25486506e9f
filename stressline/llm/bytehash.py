"""Vectorised hashing of words and byte windows over Arrow string buffers.

Everything here is numpy over one bounded chunk of whole documents, so the
memory of a call is a small multiple of ``max_bytes`` (or of one document
where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(BASE), -1, 2**64))
SHINGLE_KEYS = _rng.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
LENGTH_KEYS = _rng.integers(1, 2**63, 8, dtype=np.uint64)
OTHER_KEYS = _rng.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
#: Longest word that is hashed by table; longer ones go through xxh3.
WORD_LIMIT = 64
#: A random number for each place in a word and byte there, in two independent tables.
WORD_TABLES = _rng.integers(0, 2**64, (2, WORD_LIMIT * 256), dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) for i < n, modulo 2**64."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE_INV if inverse else BASE, dtype=np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(step)
        if len(have) <= 1 << 23:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes[i] * BASE**i, with a leading zero: a rolling hash, good to pick
    triggers. It is a polynomial modulo 2**64, so nothing is held equal by it."""
    out = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, whatever its position."""
    inv = powers(len(pre), inverse=True)
    with np.errstate(over="ignore"):
        return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def document_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole documents of up to max_bytes, or one longer document."""
    data, offsets = string_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes that do not keep words apart."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~apart[data]
    first = np.zeros(len(data), bool)
    cut = offsets[:-1]
    first[cut[cut < len(data)]] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def exact_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxh3 of each byte span."""
    view = memoryview(np.ascontiguousarray(data))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[s:e], seed) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))


def word_prefix(data: np.ndarray, start: np.ndarray, salt: int = 0) -> np.ndarray:
    """Prefix sums of the table's numbers by place in the word and byte; words begin at start, in rising order."""
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    if len(start):
        first = int(start[0])
        place = np.arange(first, n, dtype=np.int64) - np.repeat(start, np.diff(np.append(start, n)))
        np.minimum(place, WORD_LIMIT - 1, out=place)
        place <<= 8
        place |= data[first:]
        np.cumsum(WORD_TABLES[salt][place], out=out[first + 1 :])
    return out


def word_keys(data: np.ndarray, pre: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each word: two different words agree with odds of 2**-64 whatever they look like, as every place has its own random numbers."""
    with np.errstate(over="ignore"):
        h = mix(pre[end] - pre[start])
    long = np.flatnonzero(end - start > WORD_LIMIT)
    if len(long):
        h[long] = exact_keys(data, start[long], end[long], salt + 1)
    return h


def ending_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hash of the last n bytes of each word, or of the whole one where it is shorter."""
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            at = end - 1 - j
            h += np.where(at >= start, WORD_TABLES[0][(j << 8) + data[np.maximum(at, 0)].astype(np.int64)], _U(0))
    return mix(h)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased), start, end and document of every word."""
    s, e, doc = word_spans(data, offsets)
    low = LOWER[data]
    return word_keys(low, word_prefix(low, s), s, e), s, e, doc


def _shingles(h: np.ndarray, doc: np.ndarray, n_words: np.ndarray, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every k-word shingle; fewer words than k give the whole sequence as one."""
    with np.errstate(over="ignore"):
        m = len(h) - k + 1
        if m > 0:
            acc = h[:m] * keys[0]
            for j in range(1, k):
                acc += h[j : j + m] * keys[j % 8] + _U(j // 8)
            whole = doc[:m] == doc[k - 1 :]
            sh, owner = mix(acc[whole]), doc[:m][whole]
        else:
            sh, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            first = np.cumsum(n_words) - n_words
            val = LENGTH_KEYS[n_words[short] % 8].copy()
            for j in range(k - 1):
                has = n_words[short] > j
                val[has] += h[first[short[has]] + j] * keys[j % 8]
            sh, owner = np.concatenate([sh, mix(val)]), np.concatenate([owner, short])
    return sh, owner


def shingle_sets(column: pa.Array, k: int = 5, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, counts, hashes, second hashes) chunk by chunk: each document's distinct k-word
    shingles in rising order of their hash, documents one after another. The second hash comes from
    other tables and other keys. Fewer words than k give the whole sequence as one shingle, no words give none."""
    for lo, hi, data, offsets in document_chunks(column, max_bytes):
        s, e, doc = word_spans(data, offsets)
        low = LOWER[data]
        n_words = np.bincount(doc, minlength=hi - lo)
        sh, owner = _shingles(word_keys(low, word_prefix(low, s), s, e), doc, n_words, k, SHINGLE_KEYS)
        other, _ = _shingles(word_keys(low, word_prefix(low, s, 1), s, e, 1), doc, n_words, k, OTHER_KEYS)
        order = np.lexsort((sh, owner))
        sh, other, owner = sh[order], other[order], owner[order]
        if len(sh):
            keep = np.ones(len(sh), bool)
            keep[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
            sh, other, owner = sh[keep], other[keep], owner[keep]
        yield lo, np.bincount(owner, minlength=hi - lo), sh, other
