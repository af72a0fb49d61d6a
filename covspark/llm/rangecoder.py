"""Adaptive context-mixing range coder over token ids, many blocks side by side.

A block is coded by itself: its models start anew, and a CRC of its ids is kept beside it. Blocks
of a segment are the lanes of numpy arrays, so a step codes one id of every block.

An id is coded as up to three kinds of events. The order-2 model names the id that last followed
the two ids before, the order-1 model the one that last followed the id before, each with a
confidence. A flag says whether the order-2 id is right, then one whether the order-1 id is; the
flag's probability is a logistic mix of adaptive hit rates (of order 2, order 1, and of the block
as a whole), with weights that learn. An id that neither named is coded by order 0: its high and
its low byte by adaptive frequencies. All arithmetic is on integers, so any machine decodes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK = 1024
SLOTS = 1024
LOW_BITS, KEEP = 48, np.uint64((1 << 48) - 1)
FINE = np.uint64((1 << 32) - 1)
TOTAL_BITS = 15

_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], dtype=np.int32)
_SQUASH = np.array(
    [min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int32
)


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 48) - 1, np.uint64)
        self.out = np.zeros((lanes, 4 * steps + 4), np.uint32)
        self.at = np.zeros(lanes, np.int64)

    def _narrow(self, lane, start, size, bits):
        r = self.range[lane] >> np.uint64(bits)
        low = self.low[lane] + r * start.astype(np.uint64)
        span = r * size.astype(np.uint64)
        over = np.flatnonzero(low >> np.uint64(LOW_BITS))
        if over.size:
            self.out[lane[over], self.at[lane[over]] - 1] += 1  # carries are settled at the end
            low[over] &= KEEP
        small = np.flatnonzero(span <= FINE)
        if small.size:
            at = lane[small]
            self.out[at, self.at[at]] += (low[small] >> np.uint64(32)).astype(np.uint32)
            self.at[at] += 1
            low[small] = (low[small] & FINE) << np.uint64(16)
            span[small] <<= np.uint64(16)
        self.low[lane], self.range[lane] = low, span

    def flag(self, lane, p, truth):
        self._narrow(lane, np.where(truth, 0, p), np.where(truth, p, 4096 - p), 12)
        return truth

    def symbol(self, lane, cum, truth):
        at = lane * 257 + truth
        start = cum.ravel().take(at)
        self._narrow(lane, start, cum.ravel().take(at + 1) - start, TOTAL_BITS)
        return truth

    def finish(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        for shift in (32, 16, 0):
            self.out[lane, self.at] += ((self.low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint32)
            self.at += 1
        width = int(self.at.max(initial=0))
        for i in range(width - 1, 0, -1):
            self.out[:, i - 1] += self.out[:, i] >> np.uint32(16)
        digits = (self.out[:, :width] & np.uint32(0xFFFF)).astype(">u2")
        return [d[:n].tobytes().rstrip(b"\0") for d, n in zip(digits, self.at, strict=True)]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        width = max((len(p) for p in payloads), default=0) + 16
        raw = b"".join(p.ljust(width + width % 2, b"\0") for p in payloads)
        self.digits = np.frombuffer(raw, ">u2").reshape(len(payloads), -1).astype(np.uint64)
        d = self.digits
        self.code = (d[:, 0] << np.uint64(32)) | (d[:, 1] << np.uint64(16)) | d[:, 2]
        self.range = np.full(len(payloads), (1 << 48) - 1, np.uint64)
        self.at = np.full(len(payloads), 3)

    def _narrow(self, lane, code, span):
        small = np.flatnonzero(span <= FINE)
        if small.size:
            at = lane[small]
            place = np.minimum(self.at[at], self.digits.shape[1] - 1)  # zeros at a block's end were cut off
            code[small] = (code[small] << np.uint64(16)) | self.digits[at, place]
            self.at[at] += 1
            span[small] <<= np.uint64(16)
        self.code[lane], self.range[lane] = code, span

    def flag(self, lane, p, truth):
        r, code = self.range[lane] >> np.uint64(12), self.code[lane]
        edge = r * p.astype(np.uint64)
        yes = code < edge
        self._narrow(lane, np.where(yes, code, code - edge), np.where(yes, edge, r * (4096 - p).astype(np.uint64)))
        return yes

    def symbol(self, lane, cum, truth):
        r, code = self.range[lane] >> np.uint64(TOTAL_BITS), self.code[lane]
        v = np.minimum(code // r, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int32)
        flat, row = cum.ravel(), lane * 257
        s = np.zeros(len(lane), np.int64)
        for half in (128, 64, 32, 16, 8, 4, 2, 1):
            s += half * (flat.take(row + s + half) <= v)
        start = flat.take(row + s)
        self._narrow(lane, code - r * start.astype(np.uint64), r * (flat.take(row + s + 1) - start).astype(np.uint64))
        return s


def _cumulative(counts: np.ndarray) -> np.ndarray:
    """Frequencies of 256 symbols, one at least each, as cumulative sums up to 2^15."""
    total = counts.sum(axis=1, keepdims=True)
    f = 1 + counts.astype(np.int64) * ((1 << TOTAL_BITS) - 256) // np.maximum(total, 1)
    cum = np.zeros((len(counts), 257), np.int32)
    np.cumsum(f, axis=1, out=cum[:, 1:])
    cum[:, 256] = 1 << TOTAL_BITS
    return cum


class _Mix:
    """Logistic mix of three adaptive hit rates; ``rates`` holds one flat table for each input."""

    def __init__(self, lanes: int, widths: tuple[int, int, int]):
        self.widths = widths
        self.rates = [np.full(lanes * w, 24576, np.int32) for w in widths]
        self.weights = [np.full(lanes, 22000, np.int32) for _ in widths]

    def code(self, coder, lane: np.ndarray, kinds: tuple, truth: np.ndarray | None) -> np.ndarray:
        at = [lane * w + k for w, k in zip(self.widths, kinds, strict=True)]
        was = [r.take(i) for r, i in zip(self.rates, at, strict=True)]
        x = [_STRETCH.take(r >> 4) for r in was]
        w = [v.take(lane) for v in self.weights]
        dot = (w[0] * x[0] + w[1] * x[1] + w[2] * x[2]) >> 16
        p = _SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2047)
        hit = coder.flag(lane, p, truth)
        wrong = (hit * np.int32(4096) - p) * np.int32(10)
        goal = hit * np.int32(65535)
        for k in range(3):
            self.rates[k][at[k]] = was[k] + ((goal - was[k]) >> 4)
            self.weights[k][lane] = np.minimum(np.maximum(w[k] + ((x[k] * wrong + 2048) >> 12), -60000), 60000)
        return hit


def _follow(table: np.ndarray, at: np.ndarray, entry: np.ndarray, said: np.ndarray, s: np.ndarray) -> None:
    """A slot holds id * 8 + confidence; the id seen last takes it once the one there is no longer trusted."""
    sure = entry & 7
    right = (said == s) & (sure > 0)
    table[at] = np.where(right, entry + (sure < 7), np.where(sure <= 1, (s << 3) | 1, entry - sure + (sure >> 1)))


def _run(coder, lens: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Codes every lane's ids, or finds them where ``ids`` is None; all lanes but the last are as long as the first."""
    lanes, steps = len(lens), int(lens.max(initial=0))
    out = np.zeros((steps, lanes), np.int32)
    known = None if ids is None else np.ascontiguousarray(ids.T.astype(np.int32))
    two, one = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)
    first, second = _Mix(lanes, (8, 16, 1)), _Mix(lanes, (8, 8, 1))
    high, low = np.ones((lanes, 256), np.int32), np.ones((lanes, 256), np.int32)
    high_cum, low_cum = _cumulative(high), _cumulative(low)
    everyone = np.arange(lanes, dtype=np.int64)
    p1, p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        on = everyone if t < lens[-1] else everyone[:-1]
        n = len(on)
        p1, p2 = p1[:n], p2[:n]
        truth = None if known is None else known[t, :n]
        row = on * SLOTS
        at2 = row + (((p1 * 0x2545F491 + p2 * 0x9E3779B1) >> 12) & (SLOTS - 1))
        at1 = row + ((p1 * 0x9E3779B1 >> 14) & (SLOTS - 1))
        entry2, entry1 = two.take(at2), one.take(at1)
        said2, c2, said1, c1 = entry2 >> 3, entry2 & 7, entry1 >> 3, entry1 & 7
        same = (said1 == said2) & (c1 > 0)
        got = np.full(n, -1, np.int32)
        a = np.flatnonzero(c2)
        if a.size:
            said = said2.take(a)
            kinds = (c2.take(a), c1.take(a) * 2 + same.take(a), 0)
            hit = first.code(coder, a, kinds, None if truth is None else truth.take(a) == said)
            got[a[hit]] = said[hit]
        b = np.flatnonzero((got < 0) & (c1 > 0) & ~(same & (c2 > 0)))
        if b.size:
            said = said1.take(b)
            hit = second.code(coder, b, (c1.take(b), c2.take(b), 0), None if truth is None else truth.take(b) == said)
            got[b[hit]] = said[hit]
        m = np.flatnonzero(got < 0)
        if m.size:
            id_ = None if truth is None else truth.take(m)
            h = coder.symbol(m, high_cum, None if id_ is None else id_ >> 8)
            w = coder.symbol(m, low_cum, None if id_ is None else id_ & 255)
            high[m, h] += 24
            low[m, w] += 24
            got[m] = h << 8 | w
        _follow(two, at2, entry2, said2, got)
        _follow(one, at1, entry1, said1, got)
        out[t, :n] = got
        p2, p1 = p1, got.astype(np.int64)
        if t in (7, 15, 31) or t % 64 == 63:
            high_cum, low_cum = _cumulative(high), _cumulative(low)
    return out.T


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[int]]:
    """Payload and CRC (of little-endian 32-bit ids) of each block of at most ``block`` ids, all below 65536."""
    n = len(ids)
    if not n:
        return [], []
    if int(ids.max()) > 0xFFFF:
        raise ValueError("ids of 65536 and more can't be coded")
    lanes = -(-n // block)
    padded = np.zeros(lanes * block, np.int64)
    padded[:n] = ids
    rows = padded.reshape(lanes, block)
    lens = np.full(lanes, block)
    lens[-1] = n - (lanes - 1) * block
    coder = _Encoder(lanes, int(lens.max()))
    _run(coder, lens, rows[:, : int(lens.max())])
    crc = [zlib.crc32(r[:k].astype("<u4").tobytes()) for r, k in zip(rows, lens, strict=True)]
    return coder.finish(), crc


def decode(payloads: list[bytes], crcs: list[int], n: int, block: int = BLOCK) -> np.ndarray:
    """The ids; a block that doesn't give the kept CRC fails."""
    if not n:
        return np.zeros(0, np.int64)
    lens = np.full(len(payloads), block)
    lens[-1] = n - (len(payloads) - 1) * block
    rows = _run(_Decoder(payloads), lens, None)
    for i, (r, k) in enumerate(zip(rows, lens, strict=True)):
        if zlib.crc32(r[:k].astype("<u4").tobytes()) != crcs[i]:
            raise ValueError(f"block {i} is damaged")
    return np.ascontiguousarray(rows).reshape(-1)[:n] if len(payloads) > 1 else rows[0, :n]
