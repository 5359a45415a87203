"""Hashed character n-gram presence features, and the bounded training sample of labelled rows."""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.batches import text_slices
from siltbed.storage import materialize

#: Hash buckets of the features.
BUCKETS = 1 << 20
#: Tasks that read the training sample.
PARTS = 12
#: Bytes of the sample's chosen features that the driver holds while it fits; more stay in the shared folder.
FEATURE_BYTES = 1 << 25
#: Texts' values between -1 and 1 are rounded to multiples of this, so that sums over up to 16,384
#: texts are exact and don't hang on the order in which tasks add them.
GRID = 2.0**-38
_STEP = np.uint32(0x01000193)


def _prose_table() -> bytes:
    """Bytes as the classifiers see them in prose: what isn't a letter or digit becomes a blank."""
    keep = b"abcdefghijklmnopqrstuvwxyz0123456789"
    return bytes(c if c in keep or c >= 128 else 32 for c in range(256))


PROSE = _prose_table()


def prepare(text: str | None, prose: bool) -> bytes:
    """A text as bytes between blanks; ``prose``: lower-cased, without punctuation."""
    raw = (text or "").lower().encode("utf-8", "replace").translate(PROSE) if prose else (text or "").encode("utf-8", "replace")
    return b" " + raw + b" "


def hashed(buf: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the bucket of the n-gram that starts at each byte."""
    h = np.zeros(len(buf), np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > len(buf):
            return
        h = h[: len(buf) - n + 1] * _STEP + (buf[n - 1 :].astype(np.uint32) + np.uint32(1))
        if n in sizes:
            x = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            yield n, (x >> np.uint32(12)).astype(np.int32)


def repeat_bucket(text: str) -> int:
    """One of the last buckets, by the tenth of words that equal the word before them."""
    words = text.split()
    same = sum(map(operator.eq, words, words[1:]))
    return BUCKETS - 1 - (10 * same // max(1, len(words) - 1))


def windows(text: str | None, sizes: tuple[int, ...], prose: bool, window: int = 1 << 21) -> Iterator[np.ndarray]:
    """The buckets of a whole text, with repeats, part by part.

    Without ``prose``, the bucket of its share of repeated words is among them. A text longer
    than ``window`` is read in windows that overlap, so every n-gram is seen.
    """
    flat = np.frombuffer(prepare(text, prose), np.uint8)
    for lo in range(0, len(flat), window):
        for _, idx in hashed(flat[lo : lo + window + max(sizes) - 1], sizes):
            yield idx[:window]
    if not prose:
        yield np.array([repeat_bucket(text or "")], np.int32)


class Distinct:
    """Finds the distinct buckets of one text after another, in scratch space for every bucket."""

    def __init__(self, sizes: tuple[int, ...], prose: bool, active: np.ndarray | None = None):
        self.sizes, self.prose, self.active = sizes, prose, active
        self.stamp, self.seen = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, bool)

    def of(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a whole text; of ``active`` ones only, if those are given."""
        out = [np.zeros(0, np.int32)]
        for idx in windows(text, self.sizes, self.prose):
            if self.active is not None:
                idx = idx[self.active[idx]]
            idx = idx[~self.seen[idx]]
            at = np.arange(len(idx), dtype=np.int32)
            self.stamp[idx] = at
            idx = idx[self.stamp[idx] == at]
            self.seen[idx] = True
            out.append(idx)
        found = np.concatenate(out)
        self.seen[found] = False
        return found


@dataclass
class Presence:
    """The features of every training text: column numbers side by side, and how many each text has."""

    columns: np.ndarray
    counts: np.ndarray

    def _parts(self, most: int = 1 << 20) -> Iterator[tuple[slice, slice]]:
        """Runs of texts with about ``most`` columns, and where those are."""
        ends, at = np.cumsum(self.counts), 0
        while at < len(ends):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield slice(at, to), slice(base, int(ends[to - 1]))
            at = to

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """For each text, the sum of its columns' weights."""
        out = np.zeros(len(self.counts))
        for texts, some in self._parts():
            n = self.counts[texts]
            row = np.repeat(np.arange(len(n), dtype=np.int32), n)
            out[texts] = np.bincount(row, weights=weights[self.columns[some]], minlength=len(n))
        return out

    def spread(self, values: np.ndarray, width: int) -> np.ndarray:
        """For each column, the sum of its texts' values (to :data:`GRID`)."""
        values, out = np.round(values / GRID) * GRID, np.zeros(width)
        for texts, some in self._parts():
            out += np.bincount(self.columns[some], weights=np.repeat(values[texts], self.counts[texts]), minlength=width)
        return out

    def step(self, weights: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of its columns' weights, and each column's sum of its texts' values.

        ``value`` gets such sums and the numbers of their texts.
        """
        margin = self.dot(weights)
        return margin, self.spread(value(margin, np.arange(len(margin))), len(weights))


class SharedPresence:
    """As :class:`Presence`, over a table (doc_id, n, columns) in the shared folder, a text of each of ``ids``
    (ascending); every step reads it once. What reaches the driver is a row of sums from each of at most
    :data:`PARTS` tasks, 8 bytes a column."""

    def __init__(self, rows: DataFrame, ids: np.ndarray):
        self.rows, self.ids = rows.coalesce(PARTS), ids

    def step(self, weights: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, margins, total = [], [], np.zeros(len(weights))
            for batch in batches:
                for part in text_slices(batch, "columns", 1 << 17):  # at most 32 times as much unpacked
                    own, at = unpacked(part.column("n").to_pylist(), part.column("columns").to_pylist()), np.searchsorted(ids, part.column("doc_id").to_numpy())
                    margin, some = own.step(weights, lambda m, i, at=at: value(m, at[i]))
                    texts.append(at)
                    margins.append(margin)
                    total += some
            if texts:
                out = [np.concatenate(texts).astype(np.int64), np.concatenate(margins), total]
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in out], names=["texts", "margins", "total"])

        margin, total = np.zeros(len(ids)), np.zeros(len(weights))
        for r in self.rows.mapInArrow(kernel, "texts binary, margins binary, total binary").collect():
            margin[np.frombuffer(r["texts"], np.int64)] = np.frombuffer(r["margins"], np.float64)
            total += np.frombuffer(r["total"], np.float64)
        return margin, total


def packed(columns: np.ndarray, width: int) -> bytes:
    """A text's column numbers, ascending: as 32-bit integers or as a bit for each of ``width`` columns, whichever is shorter."""
    if 4 * len(columns) <= (width + 7) // 8:
        return columns.astype("<i4").tobytes()
    bits = np.zeros(width, bool)
    bits[columns] = True
    return np.packbits(bits).tobytes()


def unpacked(counts: list[int], rows: list[bytes]) -> Presence:
    """The texts of :func:`packed` rows, of which each has a number of columns."""
    columns = [np.frombuffer(r, "<i4") if len(r) == 4 * n else np.flatnonzero(np.unpackbits(np.frombuffer(r, np.uint8))).astype(np.int32) for n, r in zip(counts, rows, strict=True)]
    return Presence(np.concatenate([np.zeros(0, np.int32), *columns]), np.array(counts, np.int64))


def linear_scores(texts: list[str | None], weights: np.ndarray, sizes: tuple[int, ...], prose: bool) -> np.ndarray:
    """For each whole text, the sum of ``weights`` over its distinct buckets."""
    found = Distinct(sizes, prose, weights != 0)
    return np.array([weights[found.of(t)].sum() for t in texts], np.float64)


def _numbered(chosen: np.ndarray) -> np.ndarray:
    """For every bucket, its place in ``chosen``, or -1."""
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen), dtype=np.int32)
    return column


class Texts:
    """Labelled training texts in memory."""

    def __init__(self, texts: list[str], y: np.ndarray, sizes: tuple[int, ...], prose: bool):
        self.texts, self.y, self.sizes, self.prose = texts, np.asarray(y, np.int64), sizes, prose

    def sums(self, value: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """For each bucket, in how many texts it is and the sum of their labels' ``value``."""
        found, n, total = Distinct(self.sizes, self.prose), np.zeros(BUCKETS), np.zeros(BUCKETS)
        for t, label in zip(self.texts, self.y.tolist(), strict=True):
            idx = found.of(t)
            n[idx] += 1
            total[idx] += value[label]
        return n, total

    def presence(self, chosen: np.ndarray) -> Presence:
        """The buckets ``chosen`` that each text has."""
        column = _numbered(chosen)
        found = Distinct(self.sizes, self.prose, column >= 0)
        rows = [np.sort(column[found.of(t)]) for t in self.texts]
        return Presence(np.concatenate([np.zeros(0, np.int32), *rows]), np.array([len(r) for r in rows], np.int64))


class Sample:
    """Labelled training texts as a table (doc_id, text, y); whole texts are read by the executors alone.

    What reaches the driver is the labels, about :data:`PARTS` pairs of bucket counts (packed, a few MB
    each at most) and each text's chosen features as long as they have at most :data:`FEATURE_BYTES`;
    beyond that they stay in the shared folder, and every step of the fit reads them there.
    """

    def __init__(self, rows: DataFrame, sizes: tuple[int, ...], prose: bool):
        self.rows, self.sizes, self.prose = rows, sizes, prose
        known = sorted((r["doc_id"], r["y"]) for r in rows.select("doc_id", "y").collect())
        self.ids = np.array([i for i, _ in known], np.int64)
        self.y = np.array([y for _, y in known], np.int64)

    def sums(self, value: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        sizes, prose = self.sizes, self.prose

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n, total = Distinct(sizes, prose), np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for part in text_slices(batch, "text"):
                    for t, label in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                        idx = found.of(t)
                        n[idx] += 1
                        total[idx] += value[label]
            packed = [pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()) for a in (n, total)]
            yield pa.RecordBatch.from_arrays(packed, names=["n", "total"])

        n, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for r in self.rows.select("text", "y").mapInArrow(kernel, "n binary, total binary").collect():
            n += np.frombuffer(zlib.decompress(r["n"]), np.int32)
            total += np.frombuffer(zlib.decompress(r["total"]), np.int64)
        return n, total

    def presence(self, chosen: np.ndarray) -> Presence | SharedPresence:
        sizes, prose = self.sizes, self.prose

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            column = _numbered(chosen)
            found = Distinct(sizes, prose, column >= 0)
            for batch in batches:
                for part in text_slices(batch, "text"):
                    rows = [np.sort(column[found.of(t)]) for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array([len(r) for r in rows], pa.int32()), pa.array([packed(r, len(chosen)) for r in rows], pa.binary())], names=["doc_id", "n", "columns"])

        found = materialize(self.rows.select("doc_id", "text").mapInArrow(kernel, "doc_id long, n int, columns binary"), "features")
        if 4 * (found.agg(F.sum("n")).first()[0] or 0) > FEATURE_BYTES:
            return SharedPresence(found, self.ids)
        rows = sorted((r["doc_id"], r["n"], bytes(r["columns"])) for r in found.collect())
        return unpacked([n for _, n, _ in rows], [c for *_, c in rows])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int | None, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled documents, written to the shared folder.

    Rows are drawn by a hash of ``doc_id`` alone, so a text's length doesn't matter; those of the
    fold ``held_out``, with a null id, label or text and without a document are left out; more than
    three labels in four without a document make the sample smaller. A doc_id with several labels
    has the largest one; with several texts, the least. Texts come whole and stay on the executors.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if held_out is not None:
        known = known.filter(fold(F.col("doc_id")) != held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    # A bounded draw of labels, some of which may have no document, is broadcast to the documents.
    known = known.orderBy(F.xxhash64(F.lit(7), "__id"), "__id").limit(4 * max_rows)
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = texts.select("doc_id").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    drawn = drawn.groupBy("doc_id").agg(F.first("y").alias("y")).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_rows)
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in drawn.collect()], "__id long, y int")  # at most max_rows
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return materialize(rows.repartition(PARTS, "doc_id"), "sample")
