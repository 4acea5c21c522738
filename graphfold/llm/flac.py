"""FLAC media columns: mono PCM of 8 bits to FLAC streams and back, in seekable blocks.

The encoder cuts the samples into blocks of 4,096 and stores each as the
smallest of: constant, verbatim, a fixed linear predictor of order 0 to 4, or a
quantised linear predictor of order LPC_ORDER, the predictors with Rice residuals
in 1, 2 or 4 partitions. It writes a seek table with a point for each frame. The
decoder reads any mono stream of up to 16 bits: constant, verbatim, fixed and LPC
subframes, both Rice codings and escaped partitions. It checks each header's
CRC-8, each frame's CRC-16 and the stream's MD5, and yields PCM blocks with their
sample offsets. Quantised predictors are undone for many frames at once, sample
by sample. seek() reads one frame, at the offset that the seek table names.

Edge cases: a null text is an empty payload, which is filled up to 64 zero
bytes; texts of any length are stored whole; equal texts have equal streams, and
rows that repeat are rows of their own. A null stream has no blocks; one that is
damaged or cut short raises ValueError. Other columns are kept; one with the name
of an output is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.llm.common import SLICE_BYTES, arrow_rows, slices, table, texts_of

BLOCK, RATE, BITS, UNIT = 4096, 8000, 8, 64
LPC_ORDER = 8
#: Coefficients of the format's fixed predictors, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@lru_cache(maxsize=1)
def _crc8_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b << 1) ^ (0x107 if b & 128 else 0)
        out.append(b & 255)
    return out


def crc8(data: bytes) -> int:
    c, t = 0, _crc8_table()
    for b in data:
        c = t[c ^ b]
    return c


@lru_cache(maxsize=1)
def _crc16_table() -> np.ndarray:
    """[n, b]: what byte b adds to the CRC-16 when n bytes follow it."""
    one = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        one = (one << 1) ^ np.where(one & 0x8000, 0x18005, 0)
    one = (one & 0xFFFF).astype(np.uint16)
    out = np.empty((BLOCK, 256), np.uint16)
    out[0] = one
    for n in range(1, BLOCK):
        out[n] = (out[n - 1] << 8) ^ one[out[n - 1] >> 8]
    return out.reshape(-1)


_AFTER = np.arange(BLOCK - 1, -1, -1, dtype=np.int32) * 256


def crc16(data: np.ndarray) -> int:
    """A CRC is linear: the sum of what each byte adds, taken in pieces of up to BLOCK bytes."""
    c, t = 0, _crc16_table()
    for start in range(0, len(data), BLOCK):
        piece = data[start : start + BLOCK].astype(np.int32)
        piece[0] ^= c >> 8
        if len(piece) > 1:
            piece[1] ^= c & 255
        n = len(piece)
        carry = (c & 255) << 8 if n == 1 else 0
        c = int(np.bitwise_xor.reduce(t[_AFTER[BLOCK - n :] + piece])) ^ carry
    return c


def _bits(value: int, n: int) -> np.ndarray:
    return np.array([value >> i & 1 for i in range(n - 1, -1, -1)], np.uint8)


def _coded_number(n: int) -> bytes:
    """The format's extension of UTF-8 to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = [128 | n & 63]
    n >>= 6
    while n >= 1 << (6 - len(tail)):
        tail.append(128 | n & 63)
        n >>= 6
    return bytes([(0xFF << (7 - len(tail)) & 0xFF) | n, *reversed(tail)])


def _rice_cost(u: np.ndarray) -> tuple[int, int]:
    """Cost in bits and parameter of folded residuals in one partition."""
    n, total = len(u), int(u.sum())
    near = max(0, (total // max(n, 1)).bit_length() - 1)
    return min((int((u >> k).sum()) + n * (k + 1) + 4, k) for k in range(max(0, near - 1), near + 2))


def _rice_plan(u: np.ndarray, order: int) -> tuple[int, list[int], list[int]]:
    """Cost in bits, sizes and parameters of the best division of a block's folded residuals into 1, 2 or 4 partitions.
    The first partition lacks the block's warm-up samples."""
    n, best = len(u) + order, None
    for parts in (1, 2, 4):
        each = n // parts
        if n % parts or each <= order:
            break
        sizes = [each - order, *[each] * (parts - 1)]
        costs, at = [], 0
        for size in sizes:
            costs.append(_rice_cost(u[at : at + size]))
            at += size
        total = sum(c for c, _ in costs)
        if best is None or total < best[0]:
            best = total, sizes, [k for _, k in costs]
        elif total > best[0] * 1.02:
            break
    return best


def _rice_plans(u: np.ndarray, starts: np.ndarray, sizes: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block cost, partitions and parameters (up to 4), as _rice_plan() has them. u is 0 at warm-up samples. Sums
    over quarters give those over halves and wholes; a block that has no quarters is planned by itself."""
    quarter = sizes // 4
    bounds = (starts[:, None] + quarter[:, None] * np.arange(4)).reshape(-1)
    sums = {0: np.add.reduceat(u, bounds, dtype=np.int64).reshape(-1, 4)}
    n = np.repeat(quarter[:, None], 4, axis=1)
    n[:, 0] -= orders
    n = np.maximum(n, 1)
    costs, ks = [], []
    for each in (4, 2, 1):
        count, total = n.reshape(-1, 4 // each, each).sum(axis=2), sums[0].reshape(-1, 4 // each, each).sum(axis=2)
        near = np.maximum(np.frexp((total // count).astype(np.float64))[1] - 1, 0)
        least, chosen = np.full(near.shape, np.iinfo(np.int64).max), np.zeros(near.shape, np.int64)
        for k in range(max(0, int(near.min()) - 1), int(near.max()) + 2):
            if k not in sums:
                sums[k] = np.add.reduceat(u >> k, bounds, dtype=np.int64).reshape(-1, 4)
            cost = sums[k].reshape(-1, 4 // each, each).sum(axis=2) + count * (k + 1) + 4
            better = (np.abs(near - k) <= 1) & (cost < least)
            least[better], chosen[better] = cost[better], k
        costs.append(least.sum(axis=1))
        ks.append(chosen)
    one, two, four = costs
    parts = np.where(two < one, 2, 1)
    cost = np.minimum(one, two)
    more = ((two < one) | (two <= one * 1.02)) & (four < cost)
    cost, parts = np.where(more, four, cost), np.where(more, 4, parts)
    k = np.zeros((len(sizes), 4), np.int64)
    for of, chosen in zip((1, 2, 4), ks, strict=True):
        k[parts == of, :of] = chosen[parts == of]
    for b in np.flatnonzero((sizes % 4 != 0) | (quarter <= orders)):
        cost[b], its, found = _rice_plan(u[starts[b] + orders[b] : starts[b] + sizes[b]], int(orders[b]))
        parts[b], k[b, : len(its)] = len(its), found
    return cost, parts, k


def _rice(leads: list[tuple[int, int]], counts: np.ndarray, u: np.ndarray, sizes: np.ndarray, ks: np.ndarray) -> list[np.ndarray]:
    """For each block its lead (a number and its bits) and each partition's parameter and codes, as whole bytes. counts are
    the codes of blocks, sizes those of partitions. Each code's one and low bits, and each parameter, are added to the 32-bit
    word that they end in; what runs over goes to the word before."""
    k = np.repeat(ks, sizes)
    first, last = np.cumsum(sizes) - sizes, np.cumsum(counts) - 1
    width = (u >> k) + k + 1
    width[first] += 4  # the parameter stands before its partition's first code
    ends = np.cumsum(width, dtype=np.int64)
    lead = np.array([n for _, n in leads])
    before = np.concatenate([[0], ends[last[:-1]]])
    size = lead + ends[last] - before
    base = np.cumsum((size + 31) // 32 * 32) - (size + 31) // 32 * 32  # blocks begin at words
    ends += np.repeat(base + lead - before - 1, counts)
    begins = ends[first] - width[first] + 4  # where each parameter ends
    value = np.concatenate([u & ((1 << k) - 1) | 1 << k, ks])
    at = np.concatenate([ends, begins])
    code, word = value << (31 - (at & 31)), at >> 5
    words = np.bincount(word, code & 0xFFFFFFFF)
    words[:-1] += np.bincount(word, code >> 32, len(words))[1:]
    out = words.astype(np.uint32).astype(">u4").view(np.uint8)
    done = []
    for (v, n), begin, bits in zip(leads, (base // 8).tolist(), size.tolist(), strict=True):
        some = out[begin : begin + (bits + 7) // 8]
        some[: (n + 7) // 8] |= np.frombuffer((v << -n % 8).to_bytes((n + 7) // 8, "big"), np.uint8)
        done.append(some)
    return done


@lru_cache(maxsize=BLOCK // UNIT)
def _window(n: int) -> np.ndarray:
    return np.hanning(n + 2)[1:-1]


def _lpc(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each wanted block from its autocorrelation (Levinson and Durbin), and whether it
    has any."""
    r = np.zeros((len(sizes), order + 1))
    for b in np.flatnonzero(wanted).tolist():
        n = int(sizes[b])
        w = x[starts[b] : starts[b] + n] * _window(n)
        r[b] = [w[: n - i] @ w[i:] for i in range(order + 1)]
    there = r[:, 0] > 0
    a, err = np.zeros((len(sizes), order)), np.where(there, r[:, 0], 1)
    for i in range(order):
        k = r[:, i + 1]
        if i:
            both = np.zeros(len(sizes))
            for j in range(i):
                both += a[:, j] * r[:, i - j]
            k = k - both
        k = k / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = err * (1 - k * k)
        there &= err > 0
        a[~there], err[~there] = 0, 1
    shift = np.minimum(15, 10 - np.frexp(np.abs(a).max(axis=1))[1])
    there &= shift >= 0
    shift = np.where(there, shift, 0)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -2048, 2047).astype(np.int32), shift.astype(np.int32), there


def _subframes(x: np.ndarray, sizes: np.ndarray, lpc_order: int) -> list[np.ndarray]:
    """The bytes of blocks, whose samples stand one behind the other, each as the smallest kind of subframe."""
    starts = np.cumsum(sizes) - sizes
    firsts = [starts[sizes > j] + j for j in range(max(4, lpc_order))]  # the places of the blocks' samples j
    # the fixed order with the least sum of residuals, as usual
    diffs = [x]
    for o in range(1, 5):
        d = np.zeros_like(x)
        np.subtract(diffs[-1][1:], diffs[-1][:-1], out=d[1:])
        for at in firsts[:o]:
            d[at] = 0
        diffs.append(d)
    sums = np.array([np.add.reduceat(np.abs(d), starts, dtype=np.int64) for d in diffs])
    orders = np.where(sizes > 8, sums.argmin(axis=0), 0)
    r, of_sample = x.copy(), np.repeat(orders.astype(np.int8), sizes)
    for o in range(1, 5):
        np.copyto(r, diffs[o], where=of_sample == o)
    constant = sums[1] == 0
    u = [(r << 1) ^ (r >> 31)]
    cost, parts, ks = _rice_plans(u[0], starts, sizes, orders)
    cost += orders * BITS + 6
    best = np.where((cost < sizes * BITS) & (ks.max(axis=1) < 15), 0, -1)
    plans, least = [(orders, parts, ks)], np.where(best == 0, cost, sizes * BITS)
    wanted = ~constant & (sizes > 2 * lpc_order) & bool(lpc_order)
    if wanted.any():
        c, shift, there = _lpc(x, starts, sizes, lpc_order, wanted)
        guess = np.zeros_like(x)
        for j in range(lpc_order):
            guess[j + 1 :] += np.repeat(c[:, j], sizes)[j + 1 :] * x[: -1 - j]
        r = x - (guess >> np.repeat(shift, sizes))
        for at in firsts[:lpc_order]:
            r[at] = 0
        u.append((r << 1) ^ (r >> 31))
        orders = np.full(len(sizes), lpc_order)
        cost, parts, ks = _rice_plans(u[1], starts, sizes, np.where(there, orders, 0))
        cost += lpc_order * BITS + 15 + 12 * lpc_order
        best[there & (cost < least) & (ks.max(axis=1) < 15)] = 1
        plans.append((orders, parts, ks))
    out, coded, leads, its, of_part, k_of = [None] * len(sizes), [], [], [], [], []
    raw = (x & 255).astype(np.uint8)
    for b, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        how = int(best[b])
        if constant[b]:
            out[b] = np.array([0, raw[s]], np.uint8)
        elif how < 0:
            out[b] = np.concatenate([np.array([2], np.uint8), raw[s : s + n]])
        else:
            o, p, k = (int(plans[how][0][b]), int(plans[how][1][b]), plans[how][2][b])
            v, bits = int.from_bytes(bytes([(32 | o - 1 if how else 8 | o) << 1]) + raw[s : s + o].tobytes(), "big"), 8 + BITS * o
            if how:
                v, bits = v << 9 | 11 << 5 | int(shift[b]), bits + 9 + 12 * o
                for one in c[b].tolist():
                    v = v << 12 | one & 4095
            coded.append(b)
            leads.append((v << 6 | p.bit_length() - 1, bits + 6))
            its.append(n - o)
            of_part += [n // p - o, *[n // p] * (p - 1)]
            k_of += k[:p].tolist()
    if coded:
        # the residuals behind the warm-up samples, of each block by its best predictor
        took = np.concatenate([u[best[b]][starts[b] + sizes[b] - n : starts[b] + sizes[b]] for b, n in zip(coded, its, strict=True)])
        for b, body in zip(coded, _rice(leads, np.array(its), took, np.array(of_part), np.array(k_of)), strict=True):
            out[b] = body
    return out


#: Samples whose subframes are made at once.
AT_ONCE = 1 << 18


def encode_many(payloads: list[bytes], lpc_order: int = LPC_ORDER) -> list[bytes]:
    """For each payload a FLAC stream of unsigned 8-bit samples. Blocks of many payloads are worked on at once."""
    sizes = [min(BLOCK, len(p) - at) for p in payloads for at in range(0, len(p), BLOCK)]
    parts = [np.frombuffer(p, np.uint8)[at : at + BLOCK] for p in payloads for at in range(0, len(p), BLOCK)]
    bodies, lo = [], 0
    while lo < len(parts):
        hi, n = lo, 0
        while hi < len(parts) and (hi == lo or n + sizes[hi] <= AT_ONCE):
            n += sizes[hi]
            hi += 1
        bodies += _subframes(np.concatenate(parts[lo:hi]).astype(np.int32) - 128, np.array(sizes[lo:hi]), lpc_order)
        lo = hi
    found = iter(bodies)
    return [_stream(p, found) for p in payloads]


def encode(payload: bytes, lpc_order: int = LPC_ORDER) -> bytes:
    """A FLAC stream of unsigned 8-bit samples."""
    return encode_many([payload], lpc_order)[0]


def _stream(payload: bytes, subframes: Iterator[np.ndarray]) -> bytes:
    """The stream of a payload from its blocks' subframes, which are taken from the iterator."""
    frames, points, offset = [], [], 0
    for number, start in enumerate(range(0, len(payload), BLOCK)):
        n = min(BLOCK, len(payload) - start)
        head = bytes([0xFF, 0xF8, (12 if n == BLOCK else 7) << 4 | 4, 1 << 1]) + _coded_number(number) + (b"" if n == BLOCK else (n - 1).to_bytes(2, "big"))
        body = np.concatenate([np.frombuffer(head + bytes([crc8(head)]), np.uint8), next(subframes)])
        frames.append(body.tobytes() + crc16(body).to_bytes(2, "big"))
        points.append(start.to_bytes(8, "big") + offset.to_bytes(8, "big") + n.to_bytes(2, "big"))
        offset += len(frames[-1])
    sizes = [len(f) for f in frames] or [0]
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes())
    info += (RATE << 44 | (BITS - 1) << 36 | len(payload)).to_bytes(8, "big") + md5.digest()
    seek = b"".join(points)
    return b"".join([b"fLaC", b"\0", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, *frames])


class _Reader:
    """Bits of a frame, as one byte for each."""

    def __init__(self, data: np.ndarray):
        self.bits = np.unpackbits(data)
        self.raw = self.bits.tobytes()
        self.at = 0

    def number(self, n: int, signed: bool = False) -> int:
        v = int(self.raw[self.at : self.at + n].translate(_AS_TEXT), 2) if n else 0
        self.at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def fixed(self, count: int, n: int) -> np.ndarray:
        rows = self.bits[self.at : self.at + count * n].reshape(count, n)
        self.at += count * n
        v = np.zeros(count, np.int64)
        for j in range(n):
            v = v << 1 | rows[:, j]
        return np.where(v >> (n - 1) & 1, v - (1 << n), v) if n else v

    def unary(self) -> int:
        at = self.raw.index(1, self.at)
        n, self.at = at - self.at, at + 1
        return n

    def rice(self, count: int, k: int) -> np.ndarray:
        """count codes with k low bits each. From the one bit that ends a code's zeros follows the one that ends the
        next code's. That chain is walked in leaps of 64 codes, and what lies between is filled in by halves."""
        if not count:
            return np.zeros(0, np.int64)
        step = k + 1
        limit = min(len(self.bits), self.at + count * (step + 2) + 512)
        while True:
            bits = self.bits[self.at : limit]
            ones = np.flatnonzero(bits)
            upto = np.cumsum(bits, dtype=np.int32)
            jumps = [np.append(upto.take(np.minimum(ones + k, len(bits) - 1)).astype(np.int64), len(ones))]
            for _ in range(6):
                jumps.append(jumps[-1].take(jumps[-1]))
            leap, chain = jumps.pop(), [0]
            for _ in range((count - 1) // 64):
                chain.append(int(leap[chain[-1]]))
            chain = np.array(chain)
            for j in reversed(jumps):
                both = np.empty(2 * len(chain), np.int64)
                both[::2], both[1::2] = chain, j.take(chain)
                chain = both
            chain = chain[:count]
            if chain[-1] < len(ones) and ones[chain[-1]] + step <= len(bits):
                break
            if limit == len(self.bits):
                raise ValueError("a Rice partition ends early")
            limit = min(len(self.bits), 2 * limit - self.at)
        stop = ones.take(chain)
        begin = np.empty_like(stop)
        begin[0], begin[1:] = 0, stop[:-1] + step
        u = stop - begin
        for j in range(1, step):
            u = u << 1 | bits.take(stop + j)
        self.at += int(stop[-1]) + step
        return (u >> 1) ^ -(u & 1)


#: Bytes that a subframe's samples and coefficients before its residuals take at most: 32 of each, of up to 16 bits.
HEAD = 192
_AS_TEXT = bytes([48, 49]) + bytes(254)
_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}


class _Frame:
    """A frame's residuals behind its warm-up samples, and the predictor that they belong to."""

    __slots__ = ("start", "x", "how", "shift", "wasted")

    def __init__(self, start: int, x: np.ndarray, how: list[int], shift: int, wasted: int):
        self.start, self.x, self.how, self.shift, self.wasted = start, x, how, shift, wasted


def _read_head(r: _Reader, start: int, n: int, bits: int) -> tuple[_Frame, int]:
    """A frame with its warm-up samples, behind which residuals follow, and their number; with all samples there are none."""
    kind = r.number(8) >> 1
    wasted = 0
    if r.raw[r.at - 1]:
        wasted = r.unary() + 1
        bits -= wasted
    if kind == 0:
        return _Frame(start, np.full(n, r.number(bits, True), np.int64), [], 0, wasted), n
    if kind == 1:
        return _Frame(start, r.fixed(n, bits), [], 0, wasted), n
    if not (8 <= kind <= 12 or kind >= 32):
        raise ValueError(f"subframe type {kind} is reserved")
    order = kind - 8 if kind < 32 else kind - 31
    x = np.empty(n, np.int64)
    x[:order] = [r.number(bits, True) for _ in range(order)]
    how, shift = list(FIXED[order]) if kind < 32 else [], 0
    if kind >= 32:
        precision = r.number(4) + 1
        shift = r.number(5, True)
        how = [r.number(precision, True) for _ in range(order)]
    return _Frame(start, x, how, shift, wasted), order


def _read_subframe(r: _Reader, start: int, n: int, bits: int) -> _Frame:
    f, at = _read_head(r, start, n, bits)
    if at == n:
        return f
    order, width = at, 4 + r.number(2)
    parts = 1 << r.number(4)
    for p in range(parts):
        count = n // parts - (0 if p else order)
        k = r.number(width)
        f.x[at : at + count] = r.fixed(count, r.number(5)) if k == (1 << width) - 1 else r.rice(count, k)
        at += count
    return f


def _read_many(data: list[np.ndarray], at: np.ndarray, count: np.ndarray, order: np.ndarray, parts: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """For frames (bytes; the bit of the first Rice parameter, of 4 bits; samples, warm-up samples, partitions) the residuals,
    or None where they are not plain Rice codes, and the bit behind them. A code of each frame is read at a time."""
    flat = np.concatenate([*data, np.zeros(8, np.uint8)])
    base = np.cumsum([0, *(len(d) for d in data[:-1])]) * 8
    bits = np.unpackbits(flat)
    ones = np.append(np.flatnonzero(bits.view(bool)), len(bits)).astype(np.int32)
    upto = np.zeros(len(bits) + 1, np.int32)  # ones before each bit
    np.cumsum(bits, dtype=np.int32, out=upto[1:])
    words = flat[:-3].astype(np.uint32)
    for j in range(1, 4):
        words = words << 8 | flat[j : len(flat) - 3 + j]
    at, good = (at + base).astype(np.int32), np.ones(len(data), bool)
    found = [[] for _ in data]
    for p in range(int(parts.max(initial=0))):
        some = np.flatnonzero(good & (parts > p))
        n = count[some] // parts[some] - (0 if p else order[some])
        k = bits.take(at[some, None] + np.arange(4), mode="clip") @ np.array([8, 4, 2, 1])
        fits = (k < 15) & (n > 0) & (count[some] % parts[some] == 0)
        good[some[~fits]] = False
        by = np.flatnonzero(fits)[np.argsort(-n[fits], kind="stable")]
        some, n, k = some[by], n[by], k[by].astype(np.int32)
        if not len(some):
            continue
        begin = at[some] + 4
        stop = np.empty((int(n[0]), len(some)), np.int32)
        left = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()  # frames with more than i codes
        here, step, many = begin.copy(), k + 1, len(some)
        for row, m in zip(stop, left, strict=True):
            if m < many:
                at[some[m:many]] = here[m:many]
                here, step, many, row = here[:m], step[:m], m, row
            q = ones.take(upto.take(here, mode="clip"), mode="clip", out=row[:m])
            here = q + step
        at[some[:many]] = here
        stop = np.ascontiguousarray(stop.T)
        for i, (f, c, low) in enumerate(zip(some.tolist(), n.tolist(), k.tolist(), strict=True)):
            q = stop[i, :c]
            u = np.empty(c, np.int64)
            u[0], u[1:] = q[0] - begin[i], q[1:] - q[:-1] - (low + 1)
            if low:
                u = u << low | words.take(q + 1 >> 3, mode="clip") >> (32 - low - (q + 1 & 7)).astype(np.uint32) & ((1 << low) - 1)
            found[f].append((u >> 1) ^ -(u & 1))
    return [np.concatenate(x) if g else None for x, g in zip(found, good, strict=True)], at - base


def _undo_fixed(f: _Frame) -> None:
    order = len(f.how)
    d = [f.x[:order]]
    for _ in range(order):
        d.append(np.diff(d[-1]))
    r = f.x[order:]
    for o in range(order - 1, -1, -1):
        r = d[o][-1] + np.cumsum(r)
    f.x = np.concatenate([f.x[:order], r])


def _undo_lpc(frames: list[_Frame]) -> None:
    """Adds the predictions of quantised predictors to all frames' residuals, a sample of each at a time."""
    frames = sorted(frames, key=lambda f: -len(f.x))
    most, longest = max(len(f.how) for f in frames), len(frames[0].x)
    x = np.zeros((longest + most, len(frames)), np.int64)  # zeros before the first sample and before the first coefficient
    how = np.zeros((most, len(frames)), np.int64)
    for j, f in enumerate(frames):
        x[most : most + len(f.x), j] = f.x
        how[most - len(f.how) :, j] = f.how[::-1]
    shift, order = np.array([f.shift for f in frames]), np.array([len(f.how) for f in frames])
    left = np.searchsorted(-np.array([len(f.x) for f in frames]), -np.arange(longest), side="left")  # frames that are longer than i
    for i in range(int(order.min()), longest):
        k = int(left[i])
        guess = (how[:, :k] * x[i : i + most, :k]).sum(axis=0) >> shift[:k]
        x[i + most, :k] += guess if i >= most else np.where(i >= order[:k], guess, 0)
    for j, f in enumerate(frames):
        f.x = x[most : most + len(f.x), j].copy()


def _undo(frames: list[_Frame]) -> None:
    lpc = []
    for f in frames:
        if f.how and not f.shift and tuple(f.how) == FIXED[min(len(f.how), 4)]:
            _undo_fixed(f)
        elif f.how:
            if f.shift < 0:
                raise ValueError("a predictor's shift is negative")
            lpc.append(f)
    # frames that are short and long are kept apart, so that arrays have few gaps
    for some in (lpc[i : i + 1024] for i in range(0, len(lpc), 1024)):
        _undo_lpc(some)
    for f in frames:
        f.x = f.x << f.wasted


class Stream:
    """A stream's header and seek table. Frames are found by walking or by seek points."""

    def __init__(self, stream: bytes):
        if stream[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        self.stream, self.data = stream, np.frombuffer(stream, np.uint8)
        at, last, info, self.points = 4, False, b"", {}
        self.ahead: dict[int, tuple[_Frame, int]] = {}  # frames that are read already, by their bytes, and the bytes behind them
        while not last:
            last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
            body = stream[at + 4 : at + 4 + size]
            if len(body) < size:
                raise ValueError("the stream ends early")
            if kind == 0:
                info = body
            elif kind == 3:
                self.points = {int.from_bytes(body[i + 8 : i + 16], "big"): int.from_bytes(body[i : i + 8], "big") for i in range(0, size, 18) if body[i : i + 8] != b"\xff" * 8}
            at += 4 + size
        packed = int.from_bytes(info[10:18], "big")
        self.bits, self.total, self.largest, self.md5 = (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, int.from_bytes(info[2:4], "big"), info[18:34]
        if (packed >> 41 & 7) or self.bits > 16:
            raise ValueError("only mono streams of up to 16 bits are read")
        self.begin, self.starts = at, sorted(at + o for o in self.points)

    def head(self, at: int, start: int) -> tuple[int, int, int]:
        """Of the frame at a byte, whose header is checked: its subframe's byte, the last byte that it may have, and its samples."""
        data, stream = self.data, self.stream
        if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
            raise ValueError(f"no frame at byte {at}")
        code, rate = int(data[at + 2]) >> 4, int(data[at + 2]) & 15
        p = at + 4
        lead = int(data[p])
        p += 1 if lead < 128 else 8 - (lead ^ 0xFF).bit_length()
        n = _SIZES.get(code, 0)
        if code in (6, 7):
            n = int.from_bytes(stream[p : p + code - 5], "big") + 1
            p += code - 5
        p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(stream[at:p]) != data[p]:
            raise ValueError(f"the header's CRC-8 is wrong at byte {at}")
        if self.points.get(at - self.begin, start) != start:
            raise ValueError(f"the seek table is wrong at sample {start}")
        p += 1
        k = len(self.starts) and bisect.bisect_right(self.starts, at)
        end = (self.starts[k] if k < len(self.starts) else len(data)) if self.starts else min(len(data), p + 2 * self.largest * (self.bits + 16) // 8 + 64)
        return p, end, n

    def frame(self, at: int, start: int) -> tuple[_Frame, int]:
        """The frame at a byte, checked against its checksums, and the byte behind it."""
        p, end, n = self.head(at, start)
        r = _Reader(self.data[p:end])
        f = _read_subframe(r, start, n, self.bits)
        return f, self.closed(at, p + (r.at + 7) // 8)

    def closed(self, at: int, end: int) -> int:
        """The byte behind the checksum, which is checked, of a frame's bytes."""
        if end + 2 > len(self.data) or crc16(self.data[at:end]) != int.from_bytes(self.stream[end : end + 2], "big"):
            raise ValueError(f"the frame's CRC-16 is wrong at byte {at}")
        return end + 2

    def frames(self) -> list[_Frame]:
        out, at, done = [], self.begin, 0
        while done < self.total:
            f, at = self.ahead.pop(at, None) or self.frame(at, done)
            done += len(f.x)
            out.append(f)
        return out

    def check(self, frames: list[_Frame]) -> None:
        md5 = hashlib.md5()
        for f in frames:
            md5.update(f.x.astype("i1" if self.bits <= 8 else "<i2").tobytes())
        if any(self.md5) and md5.digest() != self.md5:
            raise ValueError("the stream's MD5 is wrong")


@contextmanager
def _whole():
    """What a stream that is cut short leads to is a ValueError."""
    try:
        yield
    except (IndexError, OverflowError) as e:
        raise ValueError("the stream is damaged or ends early") from e


def _read_ahead(streams: list[Stream]) -> None:
    """Reads frames that seek tables name, those of many streams at once. What is damaged, or has other codes than encode()
    writes, is left to Stream.frame(), which reads a frame by itself or says what is wrong."""
    some, size = [], 0
    for s in streams:
        for offset, start in s.points.items():
            at = s.begin + offset
            try:
                p, end, n = s.head(at, start)
                end = min(end, p + 2 * n * (s.bits + 16) // 8 + 64)
                r = _Reader(s.data[p : min(end, p + HEAD)])
                f, order = _read_head(r, start, n, s.bits)
                if order < n and not r.number(2):
                    parts = 1 << r.number(4)
                    some.append((s, at, p, end, f, order, r.at, parts))
                    size += end - p
            except (ValueError, IndexError, OverflowError):
                continue
            if size >= SLICE_BYTES:
                _join(some)
                some, size = [], 0
    if some:
        _join(some)


def _join(some: list[tuple]) -> None:
    data = [s.data[p:end] for s, _, p, end, *_ in some]
    residuals, ends = _read_many(data, *(np.array(c) for c in ([x[6] for x in some], [len(x[4].x) for x in some], [x[5] for x in some], [x[7] for x in some])))
    for (s, at, p, end, f, order, _, _), r, bit in zip(some, residuals, ends.tolist(), strict=True):
        if r is not None and p + (bit + 7) // 8 <= end:
            f.x[order:] = r
            try:
                s.ahead[at] = f, s.closed(at, p + (bit + 7) // 8)
            except ValueError:
                continue


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream (sample offset, samples) of its frames, all checked against their checksums and the stream's MD5."""
    with _whole():
        read = [Stream(x) for x in streams]
        _read_ahead(read)
        frames = [x.frames() for x in read]
        _undo([f for fs in frames for f in fs])
        for x, fs in zip(read, frames, strict=True):
            x.check(fs)
        return [[(f.start, f.x) for f in fs] for fs in frames]


def blocks(stream: bytes) -> list[tuple[int, np.ndarray]]:
    return decode([stream])[0]


def _joined(found: list[tuple[int, np.ndarray]]) -> bytes:
    """The unsigned 8-bit samples of a stream that encode() made."""
    return b"".join((x + 128).astype(np.uint8).tobytes() for _, x in found)


def pcm(stream: bytes) -> bytes:
    return _joined(blocks(stream))


def seek(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The block that holds a sample, with its offset: the frame at the last seek point before it, or one that follows."""
    with _whole():
        s = Stream(stream)
        if not 0 <= sample < s.total:
            raise ValueError(f"no sample {sample}")
        at, start = max(((o, x) for o, x in s.points.items() if x <= sample), key=lambda p: p[1], default=(0, 0))
        at += s.begin
        while True:
            f, after = s.frame(at, start)
            if sample < start + len(f.x):
                _undo([f])
                return start, f.x
            at, start = after, start + len(f.x)


def features(samples: bytes) -> str:
    """A short description of decoded 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"rate={RATE} channels=1 bits={BITS} samples={len(x)} peak={int(np.abs(x).max())} mean={int(x.sum()) / len(x):.4f} rms={math.sqrt(int((x * x).sum()) / len(x)):.4f} crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def to_flac(df: DataFrame, text: str = "text", output: str = "media", lpc_order: int = LPC_ORDER) -> DataFrame:
    """df with each text's UTF-8 bytes, filled up to a positive multiple of 64, as a FLAC stream."""
    kept = [c for c in df.columns if c != output]
    df = df.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                media = pa.array(encode_many([padded(t.encode("utf-8")) for t in texts_of(part, text)], lpc_order), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, media], names=[*kept, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.BinaryType())]))


def pcm_blocks(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each block of each stream: key, first_sample, n_samples and the PCM bytes."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                there = part.filter(part.column(media).is_valid())
                for k, found in zip(there.column(key), decode(there.column(media).to_pylist()), strict=True):
                    if found:
                        columns = [s for s, _ in found], [len(x) for _, x in found], [(x + 128).astype(np.uint8).tobytes() for _, x in found]
                        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), k.type), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True))], names=[key, "first_sample", "n_samples", "pcm"])

    return arrow_rows(df.select(key, media), run, [(key, kind), ("first_sample", T.LongType()), ("n_samples", T.LongType()), ("pcm", T.BinaryType())])


READ = [("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """df without its media column, with digests of the stored bytes and of the payload that is read from them. A null
    stream has nulls."""
    kept = [c for c in df.columns if c != media and c not in [n for n, _, _ in READ]]
    df = df.select(*kept, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                streams = part.column(media).to_pylist()
                found = iter(decode([x for x in streams if x is not None]))
                rows = []
                for x in streams:
                    back = None if x is None else _joined(next(found))
                    rows.append((None,) * len(READ) if x is None else (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), features(back)))
                columns = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), READ, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *(n for n, _, _ in READ)])

    return arrow_rows(df, run, [*((f.name, f.dataType) for f in df.schema.fields if f.name != media), *((n, t) for n, t, _ in READ)])


def op4_flac_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = to_flac(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media")
    return read_back(stored)


def media_payload(spark, sf_dir: str) -> DataFrame:
    """What of op4_flac_media does not depend on the format: sizes and the digest of the bytes that are read back."""
    return op4_flac_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")
