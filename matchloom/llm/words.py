"""Vectorised words, word hashes and n-gram hashes of whole columns of text.

Words are runs of bytes outside space and 0x09-0x0D. All texts of an Arrow column are scanned as one byte buffer, in
pieces that end between words, so neither a batch of many texts nor one very long text needs more than a few
working arrays of PIECE bytes (a single word longer than that is one piece).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes scanned at a time.
PIECE = 1 << 20

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE = mix64(np.arange(256, dtype=U)) | U(1)
POWER = mix64(np.arange(1000, 1000 + 256, dtype=U)) | U(1)


def _powers(n: int) -> np.ndarray:
    return POWER if n <= len(POWER) else mix64(np.arange(1000, 1000 + n, dtype=U)) | U(1)


class Bytes(NamedTuple):
    """Texts one after the other; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


def as_bytes(column: pa.Array | pa.ChunkedArray) -> Bytes:
    """UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return Bytes(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return Bytes(data[offsets[0] : offsets[-1]], offsets - offsets[0])


class Words(NamedTuple):
    """Words of all texts in order: first byte, byte after the last, number of the text, 64-bit hash."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray


def words(texts: Bytes, lower: bool = False) -> Words:
    """All words of all texts."""
    data, offsets = texts
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of texts that aren't empty
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data):  # move on to the next end of a word or text
            step = data[hi : hi + 4096]
            near = np.flatnonzero(SPACE[step])
            k = np.searchsorted(firsts, hi)
            text_end = firsts[k] if k < len(firsts) else len(data)
            cut = min(hi + int(near[0]) if len(near) else len(data), int(text_end))
            if len(near) or cut <= hi + len(step):
                hi = cut
                break
            hi += len(step)
        found.append(_piece(data[lo:hi], lo, firsts, lower))
        lo = hi
    if not found:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(0, U))
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes)


def _piece(b: np.ndarray, lo: int, firsts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~SPACE[b]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = firsts[np.searchsorted(firsts, lo) : np.searchsorted(firsts, lo + len(b))] - lo
    begin[heads] |= inside[heads]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts.astype(np.int64), starts.astype(np.int64), np.zeros(0, U)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begin[1:]
    ends = np.flatnonzero(last) + 1
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = b[at]
    with np.errstate(over="ignore"):
        values = BYTE[LOWER[codes] if lower else codes] * _powers(int(lengths.max()))[place]
        hashes = mix64(np.add.reduceat(values, np.cumsum(lengths) - lengths))
    return starts + lo, ends + lo, hashes


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the first word, text, hash) of all runs of n words within a text, in order."""
    count = len(w.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    g = np.full(count, U(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            g = mix64(g * U(0x2545F4914F6CDD1D) ^ w.hashes[j : j + count])
    first = np.flatnonzero(w.text[:count] == w.text[n - 1 :])
    return first, w.text[first], g[first]


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all runs of n words, in order of the texts; a text with fewer words, but at least one, has one run of them all."""
    _, text, g = ngrams(w, n)
    few = np.bincount(w.text)
    if not ((few > 0) & (few < n)).any():
        return text, g
    for m in range(1, n):
        first, whole, h = ngrams(w, m)
        few = np.flatnonzero(np.bincount(w.text, minlength=1)[whole] == m) if len(whole) else first
        text, g = np.concatenate([text, whole[few]]), np.concatenate([g, h[few]])
    order = np.argsort(text, kind="stable")
    return text[order], g[order]


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the bytes of each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[:-1] < offsets[1:]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def slices(column: pa.Array, limit: int = 2 * PIECE) -> list[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; one row at least."""
    sizes = np.diff(as_bytes(column).offsets)
    out, lo, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            out.append((lo, i))
            lo, held = i, 0
        held += n
    return [*out, (lo, len(sizes))] if lo < len(sizes) else out
