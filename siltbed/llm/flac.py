"""Media columns: FLAC streams of 8-bit mono samples, written and read by whole batches of frames.

The encoder picks, frame by frame, a constant, a fixed polynomial predictor, a linear predictor
(on request) or verbatim samples, codes residuals by Rice's scheme and adds a seek point per
frame. The decoder takes any mono stream of 8 bits: it steps through the Rice codes of all
frames at once, runs the predictors, and verifies both frame checksums and the stream's MD5.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.batches import text_slices

BLOCK = 4096
#: The order of the linear predictor that stored documents' frames may take.
LPC_ORDER = 8
RATE = 8000
#: Samples that the encoder and the decoder hold expanded at a time.
CHUNK, READ_CHUNK = 1 << 19, 3 << 20
U = np.uint64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = (v << 1) ^ (poly if v & top else 0)
        out.append(v & ((1 << bits) - 1))
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of ``buf``, a byte of all of them at a time."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(order), np.uint32)
    live = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), side="right")
    for i, n in enumerate(live.tolist()):
        c = crc[:n]
        crc[:n] = CRC16[(c >> np.uint32(8)) ^ buf[at[:n] + i]] ^ ((c << np.uint32(8)) & np.uint32(0xFFFF))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the UTF-8-like code of frame headers (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    width = 2
    while n >= 1 << (5 * width + 1):
        width += 1
    for _ in range(width - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> width) & 0xFF | n, *reversed(tail)])


def frame_header(number: int, samples: int) -> bytes:
    code = 0b1100 if samples == BLOCK else 0b0111
    head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b00000010]) + coded_number(number)
    if samples != BLOCK:
        head += struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


def _pack_bits(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bytes of ``value``s written one after the other with ``width`` (0 to 64) bits each."""
    end = np.cumsum(width)
    start = end - width
    words = np.zeros(int(end[-1] // 64) + 2 if len(end) else 1, np.uint64)
    some = width > 0
    v, s, w = value[some], start[some], width[some]
    word, room = s >> 6, 64 - (s & 63)
    over = w - room  # bits that spill into the next word
    first = np.where(over > 0, v >> np.maximum(over, 0).astype(U), v << np.maximum(-over, 0).astype(U))
    edge = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    if len(edge):
        words[word[edge]] = np.bitwise_or.reduceat(first, edge)
    spill = np.flatnonzero(over > 0)  # at most one symbol spills into a word
    words[word[spill] + 1] |= v[spill] << (64 - over[spill]).astype(U)
    return words.astype(">u8").view(np.uint8)[: int(-(-(end[-1] if len(end) else 0) // 8))]


def _lpc(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int] | None:
    """Quantised coefficients and shift of a linear predictor of ``x``, by Levinson's recursion."""
    f = x.astype(np.float64) * np.hanning(len(x) + 2)[1:-1]
    r = np.array([f[: len(f) - k] @ f[k:] for k in range(order + 1)])
    if r[0] <= 0:
        return None
    a, err = np.zeros(0), r[0]
    for i in range(order):
        k = (r[i + 1] - a @ r[i:0:-1]) / err if i else r[1] / err
        a = np.append(a - k * a[::-1], k)
        err *= 1 - k * k
        if err <= 0:
            return None
    shift = int(np.clip(precision - 1 - np.ceil(np.log2(np.abs(a).max() + 1e-9)), 0, 15))
    return np.clip(np.round(a * 2.0**shift), -(1 << precision - 1), (1 << precision - 1) - 1).astype(np.int64), shift


def _rice(residual: np.ndarray, order: np.ndarray, owner: np.ndarray, place: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded residuals behind each frame's first ``order`` samples, its Rice parameter and its bits of codes."""
    coded = place >= order.astype(np.int32)[owner]
    folded = np.where(coded, (residual << np.int32(1)) ^ (residual >> np.int32(31)), np.int32(0))
    largest = np.maximum.reduceat(folded, begin)
    rice, bits = np.zeros(len(sizes), np.int64), np.full(len(sizes), 1 << 60)
    near = np.log2(np.add.reduceat(folded, begin, dtype=np.int64) / np.maximum(sizes - order, 1) + 1).astype(np.int64)
    least = np.maximum(0, np.ceil(np.log2((largest + 1) / 32))).astype(np.int64)  # keeps codes within a word
    for step in (-1, 0, 1):
        k = np.clip(np.maximum(near + step, least), 0, 14)
        c = np.add.reduceat(folded >> k.astype(np.int32)[owner], begin, dtype=np.int64) + (sizes - order) * (k + 1)
        better = c < bits
        rice[better], bits[better] = k[better], c[better]
    return folded, rice, bits


def _encode_frames(x: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, lpc_order: int) -> list[bytes]:
    """Frames of consecutive ``sizes`` of the samples ``x``, without their closing checksums."""
    n_frames, ends = len(sizes), np.cumsum(sizes)
    begin = ends - sizes
    owner = np.repeat(np.arange(n_frames, dtype=np.int32), sizes)
    place = np.arange(len(x), dtype=np.int32) - begin.astype(np.int32)[owner]
    residual, best = x.copy(), np.abs(x)
    order = np.zeros(n_frames, np.int64)
    cost = np.add.reduceat(best, begin, dtype=np.int64)
    d = x.copy()
    for k in range(1, 5):
        d = np.concatenate((np.zeros(1, np.int32), d[1:] - d[:-1]))
        c = np.add.reduceat(np.where(place >= k, np.abs(d), np.int32(0)), begin, dtype=np.int64)
        better = (c < cost) & (sizes > 4)
        order[better], cost[better] = k, c[better]
        if better.any():
            residual = np.where(better[owner], d, residual)
    folded, rice, bits = _rice(residual, order, owner, place, begin, sizes)
    lpc: dict[int, tuple[np.ndarray, int]] = {}
    linear = residual.copy() if lpc_order else residual
    for f in range(n_frames if lpc_order else 0):
        s = x[begin[f] : ends[f]]
        if len(s) > 2 * lpc_order and (fit := _lpc(s, lpc_order)):
            r = s[lpc_order:] - (np.convolve(s.astype(np.int64), fit[0])[lpc_order - 1 : len(s) - 1] >> fit[1])
            if np.abs(r).max() < 1 << 15:
                lpc[f] = fit
                linear[begin[f] + lpc_order : ends[f]] = r
    if lpc:  # of both predictors, a frame takes the one that makes it shorter
        tried = np.zeros(n_frames, bool)
        tried[list(lpc)] = True
        folded_l, rice_l, bits_l = _rice(linear, np.where(tried, lpc_order, order), owner, place, begin, sizes)
        shorter = tried & (bits_l + 20 * lpc_order + 9 < bits + 8 * order)
        order, rice, bits = np.where(shorter, lpc_order, order), np.where(shorter, rice_l, rice), np.where(shorter, bits_l, bits)
        folded = np.where(shorter[owner], folded_l, folded)
        lpc = {f: fit for f, fit in lpc.items() if shorter[f]}
    lo, hi = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    constant = lo == hi
    lpc_bits = np.array([9 + 12 * lpc_order if f in lpc else 0 for f in range(n_frames)])
    verbatim = ~constant & (bits + order * 8 + 10 + lpc_bits >= 8 * sizes)
    plain = ~constant & ~verbatim
    order = np.where(plain, order, 0)
    heads = [frame_header(int(i), int(n)) for i, n in zip(numbers, sizes, strict=True)]
    # Symbols of a frame: header bytes, subframe type, warm-up, predictor, residual header, residuals, padding.
    n_head = np.array([len(h) for h in heads])
    n_extra = np.array([2 + lpc_order if plain[f] and f in lpc else 0 for f in range(n_frames)], np.int64)
    count = n_head + 1 + n_extra + 1 + sizes + 1
    base = np.cumsum(count) - count
    value, width = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), np.int64)
    flat = np.repeat(base, n_head) + np.arange(int(n_head.sum())) - np.repeat(np.cumsum(n_head) - n_head, n_head)
    value[flat], width[flat] = np.frombuffer(b"".join(heads), np.uint8), 8
    kind = np.where(constant, 0, np.where(verbatim, 1, 8 + order))
    for f in lpc:
        if plain[f]:
            kind[f] = 32 + lpc_order - 1
    sub = base + n_head
    value[sub], width[sub] = (kind << 1).astype(U), 8
    for f, (coefs, shift) in lpc.items():
        if plain[f]:
            at = sub[f] + 1 + lpc_order
            value[at : at + 2], width[at : at + 2] = (11, shift), (4, 5)
            value[at + 2 : at + 2 + lpc_order], width[at + 2 : at + 2 + lpc_order] = (coefs & 0xFFF).astype(U), 12
    at = sub + 1 + order + n_extra
    value[at[plain]], width[at[plain]] = rice[plain].astype(U), 10
    of, raw = order[owner], (x & 0xFF).astype(U)
    pos = sub[owner] + 1 + place + np.where(place >= of, n_extra[owner] + 1, 0)
    k = rice[owner]
    residuals = plain[owner] & (place >= of)
    value[pos] = np.where(residuals, (U(1) << k.astype(U)) | (folded.astype(U) & ((U(1) << k.astype(U)) - U(1))), raw)
    width[pos] = np.where(residuals, (folded >> k) + 1 + k, np.where(constant[owner] & (place > 0), 0, 8))
    total = np.add.reduceat(width, base)
    width[base + count - 1] = -total % 8
    packed = _pack_bits(value, width)
    n_bytes = (total + 7) // 8
    where, data = np.cumsum(n_bytes) - n_bytes, packed.tobytes()
    return [data[a : a + n] for a, n in zip(where.tolist(), n_bytes.tolist(), strict=True)]


def encode(payloads: list[bytes], lpc_order: int = 0) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes are unsigned 8-bit samples."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    bodies: list[bytes] = []
    todo = [(i, k, at, min(BLOCK, len(p) - at)) for i, p in enumerate(payloads) for k, at in enumerate(range(0, len(p), BLOCK))]
    at = 0
    while at < len(todo):
        to, size = at, 0
        while to < len(todo) and (to == at or size + todo[to][3] <= CHUNK):
            size += todo[to][3]
            to += 1
        part = todo[at:to]
        x = np.frombuffer(b"".join(payloads[i][a : a + n] for i, _, a, n in part), np.uint8).astype(np.int32) - np.int32(128)
        bodies += _encode_frames(x, np.array([t[3] for t in part]), np.array([t[1] for t in part]), lpc_order)
        at = to
    n_bytes = np.array([len(b) for b in bodies], np.int64)
    crc = crc16(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(n_bytes) - n_bytes, n_bytes).tolist()
    for (i, *_), body, c in zip(todo, bodies, crc, strict=True):
        frames[i].append(body + struct.pack(">H", c))
    return [_stream(p, f) for p, f in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ np.uint8(128)).tobytes()).digest()
    packed = RATE << 44 | 7 << 36 | len(payload)
    least, most = min(sizes, default=0), max(sizes, default=0)
    info = struct.pack(">HH", BLOCK, BLOCK) + least.to_bytes(3, "big") + most.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    points, at = [], 0
    for k, n in enumerate(sizes):
        points.append(struct.pack(">QQH", k * BLOCK, at, min(BLOCK, len(payload) - k * BLOCK)))
        at += n
    seek = b"".join(points)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


@dataclass
class Stream:
    """What a stream's metadata says, and where its frames begin."""

    samples: int
    rate: int
    md5: bytes
    first: int
    seek: list[tuple[int, int, int]]  # first sample, byte offset, samples
    reach: int  # bytes that frames seldom exceed


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, None, []
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            info = body
        elif kind == 3:
            seek = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or packed >> 36 & 31 != 7:
        raise ValueError("only mono streams of 8 bits are read")
    return Stream(packed & (1 << 36) - 1, packed >> 44, info[18:34], at, seek, max(int.from_bytes(info[7:10], "big"), 10 * int.from_bytes(info[2:4], "big")))


class _Bits:
    """Reads bits at many positions of a buffer at once."""

    def __init__(self, buf: np.ndarray):
        wide = np.concatenate((buf, np.zeros(16, np.uint8))).astype(np.uint64)
        self.window = np.zeros(len(buf) + 8, np.uint64)
        for j in range(8):
            self.window |= wide[j : j + len(self.window)] << U(56 - 8 * j)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more at the bit positions ``at``, leftmost first."""
        return self.window[at >> 3] << (at & 7).astype(U)

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next ``n`` (0 to 57) bits."""
        n = np.broadcast_to(n, at.shape)
        return np.where(n == 0, 0, self.peek(at) >> (64 - np.maximum(n, 1)).astype(U)).astype(np.int64)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """How many 0 bits come before the next 1."""
        v = self.peek(at) >> U(11)
        out = 52 - ((v.astype(np.float64).view(np.int64) >> 52) - 1023)
        for i in np.flatnonzero(v == 0):
            n, p = 0, int(at[i])
            while not (top := int(self.window[p >> 3]) << (p & 7) & 0xFFFFFFFFFFFFFFFF) >> 11:
                n, p = n + 53, p + 53
            out[i] = n + 64 - top.bit_length()
        return out


def _signed(v: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = np.left_shift(np.int64(1), np.asarray(bits, np.int64) - 1)
    return np.where(v >= half, v - 2 * half, v)


def _read_header(data: bytes, at: int) -> tuple[int, int]:
    """The samples of the frame at ``at`` and where its subframe begins; checks the header's sum."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] >> 4 or data[at + 3] & 1:
        raise ValueError("no mono frame here")
    if data[at + 3] >> 1 & 7 not in (0, 1):
        raise ValueError("only 8-bit samples are read")
    size, rate, p = data[at + 2] >> 4, data[at + 2] & 15, at + 4
    lead = data[p]
    p += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size == 6:
        samples, p = data[p] + 1, p + 1
    elif size == 7:
        samples, p = struct.unpack_from(">H", data, p)[0] + 1, p + 2
    else:
        samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError("a frame header's checksum is wrong")
    return samples, p + 1


def _decode_frames(data: bytes, starts: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """The samples of the frames that begin at ``starts``, and where each ends (behind its checksum)."""
    heads = [_read_header(data, s) for s in starts]
    coded_type = [data[p] >= 0x10 for _, p in heads]  # neither constant nor verbatim
    order = sorted(range(len(starts)), key=lambda i: (not coded_type[i], -heads[i][0]))
    size = np.array([heads[i][0] for i in order])
    at = np.array([heads[i][1] for i in order], np.int64) * 8
    buf = np.frombuffer(data, np.uint8)
    bits = _Bits(buf)
    kind = bits.take(at, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits aren't read")
    kind >>= 1
    at += 8
    n, most = len(order), int(size.max())
    samples = np.zeros((most, n), np.int32)
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("a reserved subframe type")
    warm = np.where(fixed, kind - 8, np.where(linear, kind - 31, np.where(verbatim, size, constant.astype(np.int64))))
    for i in range(int(warm.max(initial=0))):
        f = np.flatnonzero(warm > i)
        samples[i, f] = _signed(bits.take(at[f], 8), 8)
        at[f] += 8
    if constant.any():
        samples[:, constant] = samples[0, constant]
    precision, shift = np.zeros(n, np.int64), np.zeros(n, np.int64)
    coefs = np.zeros((32, n), np.int64)
    if (f := np.flatnonzero(linear)).size:
        precision[f] = bits.take(at[f], 4) + 1
        shift[f] = _signed(bits.take(at[f] + 4, 5), 5)
        at[f] += 9
        for j in range(int(warm[f].max())):
            g = f[warm[f] > j]
            coefs[j, g] = _signed(bits.take(at[g], precision[g]), precision[g])
            at[g] += precision[g]
    coded = fixed | linear
    parts, wide = np.ones(n, np.int64), np.full(n, 4)
    f = np.flatnonzero(coded)
    wide[f] = 4 + bits.take(at[f], 2)
    parts[f] = 1 << bits.take(at[f] + 2, 4)
    at[f] += 6
    rice, escape = np.zeros(n, np.int64), np.full(n, -1)
    n_coded = int(coded.sum())  # these come first, by falling size: the live ones are a prefix
    live = np.searchsorted(-size[:n_coded], -np.arange(1, most + 1), side="right")
    span = size // parts
    late = int(warm[:n_coded].max(initial=0))
    split = bool((parts[:n_coded] > 1).any())
    for i in range(most):
        m = int(live[i])
        if not m:
            break
        if i <= late or split:
            new = np.flatnonzero((warm[:m] == i) | ((i > warm[:m]) & (i % span[:m] == 0)))
            if len(new):
                rice[new] = bits.take(at[new], wide[new])
                at[new] += wide[new]
                raw = rice[new] == (1 << wide[new]) - 1
                escape[new] = -1
                e = new[raw]
                escape[e] = bits.take(at[e], 5)
                at[e] += 5
                rest = (63 - rice).view(U)
                escapes = bool((escape[:n_coded] >= 0).any())
        if i < late or escapes:
            _residual_step(bits, samples[i], at, rice, escape, np.flatnonzero(warm[:m] <= i))
            continue
        a, k = at[:m], rice[:m]
        v = bits.window[a >> 3] << (a & 7).view(U)
        used = 1076 - ((v >> U(11)).astype(np.float64).view(np.int64) >> 52)  # zeros and the one behind them
        rem = (v << used.view(U)) >> U(1) >> rest[:m]
        if int(used.max()) + 15 > 57 and int((used + k).max()) > 57:
            _residual_step(bits, samples[i], at, rice, escape, np.arange(m))
            continue
        samples[i, :m] = ((used - 1) << k) | rem.view(np.int64)
        a += used + k
    for f0 in range(0, n_coded, 256):  # unfold the codes to signed residuals
        f1 = min(n_coded, f0 + 256)
        u = samples[:, f0:f1]
        res = (u >> 1) ^ -(u & 1)
        keep = (np.arange(most)[:, None] < warm[f0:f1])
        samples[:, f0:f1] = np.where(keep, u, res)
    for o in range(1, 5):
        f = np.flatnonzero(fixed & (warm == o))
        if len(f):
            s = samples[:, f]
            diffs = [s[:o]]
            for _ in range(o - 1):
                diffs.append(np.diff(diffs[-1], axis=0))
            run = s[o:].astype(np.int64)
            for j in reversed(range(o)):
                run = np.cumsum(np.concatenate((diffs[j][:1], run)), axis=0)
            samples[:, f] = run
    for o in np.unique(warm[linear]).tolist():
        f = np.flatnonzero(linear & (warm == o))
        s, c = samples[:, f].astype(np.int64), coefs[:o, f][::-1]
        for i in range(o, most):
            s[i] += (c * s[i - o : i]).sum(axis=0) >> shift[f]
        samples[:, f] = s
    end = (at + 7) >> 3
    first = np.array([starts[i] for i in order], np.int64)
    stored = (buf[end].astype(np.uint32) << np.uint32(8)) | buf[end + 1]
    if (crc16(buf, first, end - first) != stored).any():
        raise ValueError("a frame's checksum is wrong")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    ends = [0] * n
    for j, i in enumerate(order):
        out[i] = samples[: size[j], j]
        ends[i] = int(end[j]) + 2
    return out, ends


def _residual_step(bits: _Bits, row: np.ndarray, at: np.ndarray, rice: np.ndarray, escape: np.ndarray, f: np.ndarray) -> None:
    """Reads the next folded residual of the frames ``f``, whatever its length or form, into ``row``."""
    a, k = at[f], rice[f]
    raw = escape[f] >= 0
    q = np.where(raw, 0, bits.zeros(a))
    u = (q << k) | bits.take(a + q + 1, np.where(raw, 0, k))
    w = np.where(raw, escape[f], 0)
    x = np.where(w > 0, _signed(bits.take(a, w), np.maximum(w, 1)), 0)
    row[f] = np.where(raw, np.where(x >= 0, 2 * x, -2 * x - 1), u)
    at[f] = a + np.where(raw, w, q + 1 + k)


@dataclass
class Block:
    """Decoded PCM: unsigned 8-bit samples from ``first`` on."""

    first: int
    pcm: bytes


def _decode_part(streams: list[bytes], heads: list[Stream], nexts: list[dict[int, int]], part: list[tuple[int, int, int]]) -> tuple[list[np.ndarray], list[int], dict[int, int]]:
    """As ``_decode_frames`` for the frames of ``part``, and how far each stream's offsets are shifted."""
    for bounded in (True, False):
        shift, pieces, offset, cut = {}, [], 0, False
        for i in sorted({i for i, _, _ in part}):  # of a long stream, only the bytes around these frames
            mine = [p for s, _, p in part if s == i]
            a, b = min(mine), nexts[i].get(max(mine), len(streams[i]))
            if bounded and not nexts[i] and max(mine) + heads[i].reach < b:
                b, cut = max(mine) + heads[i].reach, True
            pieces.append(streams[i][a:b])
            shift[i] = offset - a
            offset += b - a
        try:
            return *_decode_frames(b"".join(pieces) + bytes(2), [shift[i] + p for i, _, p in part]), shift
        except (IndexError, ValueError, struct.error):
            if not cut:
                raise
    raise AssertionError("the whole rest was read")


def decode(streams: list[bytes], verify: bool = True) -> list[list[Block]]:
    """The PCM blocks of every stream; frames are found by seek points, or else one by one.

    A frame may be of any length: it ends at the next seek point, or else the whole rest of the
    stream is read where a bounded part of it doesn't do.
    """
    heads = [read_metadata(s) for s in streams]
    out: list[list[Block]] = [[] for _ in streams]
    whole = [sum(p[2] for p in h.seek) == h.samples for h in heads]
    offsets = [sorted(p[1] + h.first for p in h.seek) if w else [] for h, w in zip(heads, whole, strict=True)]
    nexts = [dict(zip(o, [*o[1:], len(s)], strict=False)) for o, s in zip(offsets, streams, strict=True)]
    # (stream, its next sample, where the frame begins in the stream)
    todo = [(i, p[0], h.first + p[1]) for i, h in enumerate(heads) if whole[i] for p in h.seek]
    todo += [(i, 0, h.first) for i, h in enumerate(heads) if not whole[i] and h.samples]
    while todo:
        later, at = [], 0
        while at < len(todo):
            part = todo[at : at + READ_CHUNK // BLOCK]
            at += len(part)
            got, ends, shift = _decode_part(streams, heads, nexts, part)
            for (i, first, _), x, end in zip(part, got, ends, strict=True):
                out[i].append(Block(first, (x + 128).astype(np.uint8).tobytes()))
                if not whole[i] and first + len(x) < heads[i].samples:
                    later.append((i, first + len(x), end - shift[i]))
        todo = later
    for i, h in enumerate(heads):
        out[i].sort(key=lambda b: b.first)
        if verify and h.md5 != bytes(16):
            pcm = np.frombuffer(b"".join(b.pcm for b in out[i]), np.uint8) ^ np.uint8(128)
            if hashlib.md5(pcm.tobytes()).digest() != h.md5:
                raise ValueError("a stream's MD5 is wrong")
    return out


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, filled with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def feature(blocks: list[Block], rate: int = RATE) -> str:
    """Rate, blocks, samples, peak, mean and sign changes of the decoded signal."""
    x = np.frombuffer(b"".join(b.pcm for b in blocks), np.uint8).astype(np.int64) - 128
    return f"flac/{rate}/1/8;blocks={len(blocks)};samples={len(x)};peak={np.abs(x).max(initial=0)};mean={x.mean():.6f};crossings={int((np.diff(np.signbit(x)) != 0).sum())}"


def store_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): every whole text as a FLAC stream.

    Null texts are stored as empty ones: 64 bytes 0. Equal texts give equal streams; repeated rows
    stay, null ids stay null. An empty table gives an empty result. Other columns aren't read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", READ_CHUNK):
                texts = part.column("text").to_pylist()
                raw = [payload(t) for t in texts]
                n = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(p) for p in raw], pa.int64()), pa.array(encode(raw, LPC_ORDER), pa.binary())],
                    names=["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, n_bytes long, payload_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, samples, pcm) of a table of streams (doc_id, media).

    Null streams and streams without samples have no blocks; repeated rows have theirs each, null ids
    stay null. An empty table gives an empty result. A stream that is damaged, or isn't mono of 8
    bits, fails the task.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "media", READ_CHUNK):
                found = decode(part.column("media").to_pylist())
                rows = [(d, k, b.first, len(b.pcm), b.pcm) for d, bs in zip(part.column("doc_id").to_pylist(), found, strict=True) for k, b in enumerate(bs)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "block", "first_sample", "samples", "pcm"])

    return media.select("doc_id", "media").where("media is not null").mapInArrow(kernel, "doc_id long, block int, first_sample long, samples long, pcm binary")


def document_features(docs: DataFrame) -> DataFrame:
    """One row per document with the sizes and digests of its stream, read back from its bytes.

    ``block_samples`` and ``block_offsets`` are its seek points: the first sample of every block and
    the byte where the block's frame begins in the stream.

    Null texts are stored as empty ones: 64 bytes 0. Equal texts have equal values; repeated rows
    stay, null ids stay null. An empty table gives an empty result. Other columns aren't read. A
    wrong checksum fails the task rather than giving a row.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", READ_CHUNK):
                texts = part.column("text").to_pylist()
                raw = [payload(t) for t in texts]
                sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
                media = encode(raw, LPC_ORDER)
                del raw
                read, heads = decode(media), [read_metadata(m) for m in media]
                back = [b"".join(b.pcm for b in bs) for bs in read]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([len(b) for b in back], pa.int64()),
                     pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([zlib.crc32(b[-64:]) for b in back], pa.int64()),
                     pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                     pa.array([feature(bs) for bs in read]), pa.array([[p[0] for p in h.seek] for h in heads], pa.list_(pa.int64())),
                     pa.array([[h.first + p[1] for p in h.seek] for h in heads], pa.list_(pa.int64()))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "block_samples", "block_offsets"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, block_samples array<long>, block_offsets array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, schema)
