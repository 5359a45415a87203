"""Helpers for Arrow kernels: bounded slices of a batch, groups of a sorted stream, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel holds expanded at a time.
SLICE_BYTES = 1 << 20
#: 64-bit odd multipliers of the rolling hash and of the finishing mix (splitmix64).
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + ROLL
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``limit`` bytes in ``column``, or one longer row."""
    sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        to = min(to, at + 4096)
        yield batch.slice(at, to - at)
        at = to


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal ``keys`` from batches that are sorted by them; only one group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _word_bytes() -> np.ndarray:
    is_word = np.zeros(256, bool)
    is_word[128:255] = True  # bytes of letters beyond ASCII; 255 never occurs in UTF-8
    for c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        is_word[c] = True
    return is_word


WORD_BYTES = _word_bytes()


def _segments(text: str, limit: int) -> Iterator[str]:
    """``text`` in parts of at most about ``limit`` characters, cut only between words."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and (text[cut].isalnum() or text[cut] == "_" or ord(text[cut]) > 127):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, in order, and each text's number of words.

    A word is a run of ASCII letters, digits, underscores and non-ASCII characters.
    """
    parts, owner = [], []
    for i, t in enumerate(texts):
        for s in _segments((t or "").lower(), 1 << 22):
            parts.append(s.encode("utf-8", "replace"))
            owner.append(i)
    out, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= 2 * SLICE_BYTES):
            size += len(parts[to]) + 1
            to += 1
        buf = np.frombuffer(b"\xff".join(parts[at:to]) + b"\xff", np.uint8)
        hashes, starts = _hash_runs(buf)
        ends = np.cumsum([len(p) + 1 for p in parts[at:to]])
        n = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
        np.add.at(counts, np.asarray(owner[at:to]), n)
        out.append(hashes)
        at = to
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def _hash_runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of word bytes and where it starts; ``buf`` ends outside a word."""
    inside = np.concatenate(([False], WORD_BYTES[buf]))
    edge = inside[1:] != inside[:-1]
    edges = np.flatnonzero(edge)
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    n = len(buf)
    powers = np.full(n, ROLL, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
    raw = sums[ends] - sums[starts]
    # Divide by ROLL**start, so that a word hashes alike wherever it stands.
    inverse = np.uint64(pow(int(ROLL), -1, 1 << 64))
    inv_powers = np.full(n, inverse, np.uint64)
    inv_powers[0] = 1
    np.multiply.accumulate(inv_powers, out=inv_powers)
    return mix64(raw * inv_powers[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, and their number per text.

    A text with fewer words has one shingle of all its words; without words it has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, np.uint64), n_out
    rolled = np.zeros(len(words), np.uint64)
    for j in range(width):
        part = words[j:]
        rolled[: len(part)] = rolled[: len(part)] * ROLL + part
    owner = np.repeat(np.arange(len(counts)), n_out)
    first = np.cumsum(n_out) - n_out
    where = starts[owner] + (np.arange(int(n_out.sum())) - first[owner])
    out = mix64(rolled[where])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[i])
        for w in words[starts[i] : ends[i]]:
            h = np.uint64((int(h) * int(ROLL) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[first[i]] = mix64(np.array([h], np.uint64))[0]
    return out, n_out
