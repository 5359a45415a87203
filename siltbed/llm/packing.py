"""Packing documents into sequences: best fit, then swap-based local search.

A kernel turns whole texts into token pieces; only longer documents are cut. Pieces are dealt
into blocks of bounded size, and every block is packed on its own: best fit in falling order,
then moves, one-for-one and two-for-one exchanges between underfull sequences that raise the
sum of squared fills, until sequences empty or no exchange helps.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.batches import text_slices
from siltbed.storage import materialize

#: Pieces that a block holds on average: what one task packs at a time.
BLOCK_PIECES = 8192
#: Characters of a long text that are encoded at a time.
PART_CHARS = 200_000

# How the byte-level vocabulary splits a text before it merges bytes (fixed values).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose classes no Unicode version has changed; other texts go through the tokenizer itself.
_PLAIN = re.compile("[\\x20-\\x7e\\t\\n\\r\u00a0-\u024f]*")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of the vocabulary file at ``path``, as little-endian unsigned 32-bit bytes.

    The file's merges are ranked by id, so plain texts take the faster of two libraries, which
    gives the same ids; texts with special tokens or rarer characters take the file's own.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("plain", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str) -> Iterator[str]:
        """``text`` in parts that begin with the blank before a word, where no token crosses."""
        at = 0
        while len(text) - at > PART_CHARS:
            to = text.find(" ", at + PART_CHARS)
            while to >= 0 and (to + 1 >= len(text) or text[to - 1].isspace() or text[to + 1].isspace()):
                to = text.find(" ", to + 1)
            if to < 0:
                break
            yield text[at:to]
            at = to
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or not _PLAIN.fullmatch(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(np.array(self.fast.encode_ordinary(part), "<u4").tobytes() for part in self._parts(text))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of the vocabulary at ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``size`` but for a shorter first one."""
    if total <= size:
        return [(0, total)]
    first = total % size or size
    return [(0, first), *((s, size) for s in range(first, total, size))]


def tokenize(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and ``end_id``."""
    stop = np.array([end_id], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, rows = part.column("doc_id").to_pylist(), []
                for doc, text in zip(ids, part.column("text").to_pylist(), strict=True):
                    raw = enc.encode(text or "") + stop
                    for k, (start, n) in enumerate(cut(len(raw) // 4, size)):
                        rows.append((doc, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(kernel, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Underfull sequences by their free space, and which of them hold a piece of a length."""

    def __init__(self, size: int):
        self.size = size
        self.items: list[list[int]] = []  # piece numbers
        self.fill: list[int] = []
        self.order: list[tuple[int, int]] = []  # (free, bin), sorted

    def best(self, need: int, but: int = -1) -> int:
        """The bin with the least free space of at least ``need``, other than ``but``; or -1."""
        at = bisect_left(self.order, (need, -1))
        while at < len(self.order):
            if self.order[at][1] != but:
                return self.order[at][1]
            at += 1
        return -1

    def set_fill(self, b: int, fill: int) -> None:
        at = bisect_left(self.order, (self.size - self.fill[b], b))
        if at < len(self.order) and self.order[at] == (self.size - self.fill[b], b):
            del self.order[at]
        self.fill[b] = fill
        if 0 < fill < self.size:
            insort(self.order, (self.size - fill, b))

    def open(self) -> int:
        self.items.append([])
        self.fill.append(0)
        return len(self.items) - 1


class _Partners:
    """Where the pieces are, and which sequences changed since a sequence was last searched in vain."""

    def __init__(self, bins: _Bins, lengths: list[int]):
        self.length = np.array(lengths, np.int64)
        self.where = np.zeros(len(lengths), np.int64)
        for b, items in enumerate(bins.items):
            self.where[items] = b
        self.fill = np.array(bins.fill, np.int64)
        self.alive = np.arange(len(lengths))  # no piece of an underfull sequence is missing
        self.changed: list[int] = []
        self.seen: dict[int, int] = {}  # how long ``changed`` was after a search in vain

    def renew(self, size: int) -> None:
        self.alive = self.alive[self.fill[self.where[self.alive]] < size]  # a full sequence stays full

    def of(self, bins: _Bins, source: int) -> np.ndarray:
        """The pieces that an exchange of ``source`` hasn't been tried with as they are now."""
        pieces = self.alive
        if source in self.seen:
            new = set(self.changed[self.seen[source] :])
            pieces = np.array([x for b in new if bins.fill[b] < bins.size for x in bins.items[b]], np.int64)
        return pieces[self.where[pieces] != source]


def pack(lengths: list[int], size: int = 1024, passes: int | None = None) -> list[list[int]]:
    """Sequences (lists of positions in ``lengths``) of at most ``size`` tokens, as few as found.

    The search ends where no sequence can be spared or no move or exchange helps, or after ``passes``.
    """
    bins = _Bins(size)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        b = bins.best(n) if n < size else -1
        if b < 0:
            b = bins.open()
        bins.items[b].append(i)
        bins.set_fill(b, bins.fill[b] + n)
    least, done = -(-sum(lengths) // size), 0
    partners = _Partners(bins, lengths)
    while done != passes and len([x for x in bins.items if x]) > least and _search(bins, lengths, partners):
        done += 1
    return [x for x in bins.items if x]


def _search(bins: _Bins, lengths: list[int], partners: _Partners) -> bool:
    """One pass over the underfull sequences, emptiest first; whether anything got better."""
    better = False
    partners.renew(bins.size)
    for _, source in sorted(bins.order, reverse=True):
        while 0 < bins.fill[source] < bins.size and (_move(bins, lengths, partners, source) or _exchange(bins, lengths, partners, source)):
            better = True
    return better


def _shift(bins: _Bins, lengths: list[int], partners: _Partners, source: int, target: int, out: list[int], back: list[int]) -> None:
    """Moves ``out`` from source to target and ``back`` the other way."""
    bins.items[source] = [x for x in bins.items[source] if x not in out] + back
    bins.items[target] = [x for x in bins.items[target] if x not in back] + out
    delta = sum(lengths[x] for x in out) - sum(lengths[x] for x in back)
    bins.set_fill(source, bins.fill[source] - delta)
    bins.set_fill(target, bins.fill[target] + delta)
    partners.where[out], partners.where[back] = target, source
    for b in (source, target):
        partners.fill[b] = bins.fill[b]
        partners.changed.append(b)
        partners.seen.pop(b, None)


def _gain(fill_source, fill_target, delta):
    """How the sum of squared fills changes when ``delta`` tokens go from source to target."""
    return 2 * delta * (fill_target - fill_source + delta)


def _move(bins: _Bins, lengths: list[int], partners: _Partners, source: int) -> bool:
    """The longest piece that another sequence takes with a gain, to the fullest that does."""
    for i in sorted(bins.items[source], key=lambda i: -lengths[i]):
        target = bins.best(lengths[i], source)
        if target >= 0 and _gain(bins.fill[source], bins.fill[target], lengths[i]) > 0:
            _shift(bins, lengths, partners, source, target, [i], [])
            return True
    return False


def _exchange(bins: _Bins, lengths: list[int], partners: _Partners, source: int) -> bool:
    """The best exchange of one or two pieces for one shorter piece of any underfull sequence."""
    items, outs = bins.items[source], {}
    for k, i in enumerate(items):
        for j in items[:k]:
            outs.setdefault(lengths[i] + lengths[j], [i, j])
    outs |= {lengths[i]: [i] for i in items}
    sizes = np.array(sorted(outs), np.int64)
    pieces = partners.of(bins, source)
    length, fill = partners.length[pieces], partners.fill[partners.where[pieces]]
    some = (length < sizes[-1]) & (length + bins.size - fill >= sizes[0])
    pieces, length, fill = pieces[some], length[some], fill[some]
    best, found = 0, None
    step = max(1, (1 << 18) // max(1, len(pieces)))
    for at in range(0, len(sizes) if len(pieces) else 0, step):
        delta = sizes[at : at + step, None] - length
        gain = np.where((delta > 0) & (delta <= bins.size - fill), _gain(bins.fill[source], fill, delta), 0)
        k = int(gain.argmax())
        if gain.flat[k] > best:
            best, found = int(gain.flat[k]), (int(sizes[at + k // len(pieces)]), int(pieces[k % len(pieces)]))
    if found is None:
        partners.seen[source] = len(partners.changed)
        return False
    _shift(bins, lengths, partners, source, int(partners.where[found[1]]), outs[found[0]], [found[1]])
    return True


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, block: int = BLOCK_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``.

    Null texts are packed as empty ones: a document of ``end_id`` alone. Repeated rows are packed
    one by one; null ids stay null. An empty table gives an empty result. Other columns aren't read.
    Blocks are drawn by a number given to each written piece, so no repeated row fills one.
    """
    pieces = materialize(tokenize(docs, tokenizer, size, end_id).withColumn("n", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, round(pieces.count() / block))

    def kernel(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_pylist()
        number = group.column("block")[0].as_py() << 32
        order, sequence, offset = [], [], []
        for k, items in enumerate(pack(lengths, size)):
            at = 0
            for i in items:
                order.append(i)
                sequence.append(number + k)
                offset.append(at)
                at += lengths[i]
        out = group.drop_columns(["block"]).take(pa.array(order, pa.int64()))
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("long")).drop("n")
    return dealt.groupBy("block").applyInArrow(kernel, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
