"""Media columns: lossless FLAC in a binary column, and PCM blocks with sample offsets read back from it.

``store`` writes bytes as one FLAC stream a row: 8-bit mono, frames of 576
samples (a size the format names), each as a constant, as plain samples or as
Rice-coded residuals of a fixed or a linear predictor, whichever is shortest.
``pcm_blocks`` decodes any FLAC column, of up to 8 channels and 24 bits, into
rows of BLOCK_FRAMES frames with the sample they begin at and the byte of the
stream where their first frame stands; ``pcm_range`` reads a span of samples
from such a table by its offsets alone.

A task decodes many frames at once. Frames carry no length, so every place with
a sync code and a header whose CRC-8 holds is taken as a possible start and
decoded; then the frames of a stream are linked: each must begin where the one
before ends, bear the next number and agree with its CRC-16, and the samples
with the total and the MD5 of the stream's head. A chance sync code inside a
frame is never reached by a link, and a damaged frame is always noticed. Within
a slice of LANES frames, step t reads sample t of all of them.

Everything is integer arithmetic (predictors are solved by element-wise double
operations from exact integer sums), so equal bytes give equal streams whatever
batch they are in.

Cases: a null text is an empty one, and an empty one still has a frame; equal
texts have equal streams; a null or damaged stream gives one row with ``error``
and no samples; a stream without samples gives one empty block; repeated rows
are rows of their own; other columns pass if asked for; an empty table gives no
row. A frame of over 8 bytes a sample plus 1 KB is refused as damaged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import small_batches, spread, table, whole_text

UNIT = 576
#: Frames worked on at once, and frames of one PCM block.
LANES, BLOCK_FRAMES = 1024, 64
#: The encoder's linear predictor: order and bits of a coefficient; partitions are 2^PARTS.
ORDER, PRECISION, PARTS = 8, 12, 2
RATE = 8000
# fixed values: block sizes, sample sizes and fixed predictors that the format gives by number
_BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{i: 256 << (i - 8) for i in range(8, 16)}}
_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
_U64 = np.uint64


@lru_cache(maxsize=8)
def _crc_table(bits: int, poly: int, width: int) -> np.ndarray:
    """The remainder that a byte leaves, by its distance from the end."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    last = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        last = ((last << 1) ^ np.where(last & top, poly, 0)) & mask
    out = [last]
    while len(out) < width:
        c = out[-1]
        out.append((((c << 8) & mask) ^ last[c >> (bits - 8)]) & mask)
    return np.array(out, np.uint16)


def crc(rows: np.ndarray, bits: int = 16, poly: int = 0x8005) -> np.ndarray:
    """CRC of each row of bytes; zeros in front change nothing."""
    c, wide = np.zeros(len(rows), np.int64), UNIT * 2
    rows = np.pad(rows, ((0, 0), (-rows.shape[1] % wide if rows.shape[1] > wide else 0, 0)))
    for a in range(0, rows.shape[1], wide):
        part = rows[:, a : a + wide].copy()
        if a:
            for j in range(bits // 8):  # what is left so far goes into the next bytes
                part[:, j] ^= (c >> (bits - 8 * j - 8) & 255).astype(np.uint8)
        n = part.shape[1]
        c = np.bitwise_xor.reduce(_crc_table(bits, poly, wide)[np.arange(n - 1, -1, -1), part], axis=1).astype(np.int64)
    return c


def _right_aligned(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Slices of a buffer as rows, zeros in front."""
    wide = int(length.max(initial=1))
    at = (start + length - wide)[:, None] + np.arange(wide)
    return np.where(at >= start[:, None], buf[np.maximum(at, 0)], 0).astype(np.uint8)


def _number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 of the format."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    head = (0xFF << (7 - more)) & 0xFF
    return bytes([head | n >> (6 * more)] + [0x80 | (n >> 6 * i) & 0x3F for i in range(more - 1, -1, -1)])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (frames, ORDER) and shifts of linear predictors, from exact autocorrelations."""
    r = [(x[:, : UNIT - k] * x[:, k:]).sum(axis=1, dtype=np.int64).astype(np.float64) for k in range(ORDER + 1)]
    a, error = np.zeros((ORDER, len(x))), r[0] * (1 + 2.0**-20) + 1.0
    for i in range(ORDER):
        k = r[i + 1].copy()
        for j in range(i):
            k = k - a[j] * r[i - j]
        k = k / error
        before = a.copy()
        a[i] = k
        for j in range(i):
            a[j] = before[j] - k * before[i - 1 - j]
        error = np.maximum(error * (1.0 - k * k), 1.0)
    most = np.abs(a).max(axis=0)
    shift = np.clip(PRECISION - 1 - np.frexp(most)[1], 0, 15)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(np.ldexp(a, shift)), -top, top).astype(np.int32).T, shift.astype(np.int32)


def encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames (n, UNIT) of samples as FLAC frames."""
    n = len(x)
    x = x.astype(np.int32)
    cand, e = [x], x
    for o in range(1, 5):
        e = np.concatenate([e[:, :1], np.diff(e, axis=1)], axis=1)
        cand.append(e)
    coef, shift = _linear(x)
    pred = np.zeros_like(x)
    for j in range(ORDER):
        pred[:, j + 1 :] += coef[:, j : j + 1] * x[:, : UNIT - j - 1]
    cand.append(x - (pred >> shift[:, None]))
    orders = np.array([0, 1, 2, 3, 4, ORDER])
    cost = np.array([np.abs(c[:, ORDER:]).sum(axis=1) for c in cand])
    kind = cost.argmin(axis=0)
    order = orders[kind]
    res = np.stack(cand)[kind, np.arange(n)]
    t = np.arange(UNIT)
    real = t >= order[:, None]
    u = np.where(real, (res << 1) ^ (res >> 31), 0)
    parts = 1 << PARTS
    spent = np.array([(u >> k).reshape(n, parts, -1).sum(axis=2) + k * real.reshape(n, parts, -1).sum(axis=2) for k in range(15)])
    k = spent.argmin(axis=0)
    param = np.repeat(k, UNIT // parts, axis=1)
    head = 8 + 8 * order + np.where(kind == 5, 9 + PRECISION * ORDER, 0)
    coded = head + 6 + 4 * parts + spent.min(axis=0).sum(axis=1) + UNIT - order
    flat = (x == x[:, :1]).all(axis=1)
    plain = ~flat & (coded >= 8 + 8 * UNIT)
    ruled = ~flat & ~plain
    body = np.where(flat, 16, np.where(plain, 8 + 8 * UNIT, coded))
    names = [_number(i) for i in numbers]
    header = np.array([5 + len(b) for b in names])
    size = header + (body + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(start[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1

    at = (start[:-1] + header) * 8
    code = np.where(flat, 0, np.where(plain, 1, np.where(kind == 5, 32 + ORDER - 1, 8 + order)))
    put(at, code << 1, 8)
    put(at[flat] + 8, x[flat, 0], 8)
    put(at[plain][:, None] + 8 + 8 * t, x[plain], 8)
    for o in np.unique(order[ruled]):
        w = np.flatnonzero(ruled & (order == o))
        put(at[w][:, None] + 8 + 8 * np.arange(o), x[w, :o], 8)
    w = np.flatnonzero(ruled & (kind == 5))
    spot = at[w] + 8 + 8 * ORDER
    put(spot, np.full(len(w), PRECISION - 1), 4)
    put(spot + 4, shift[w], 5)
    put(spot[:, None] + 9 + PRECISION * np.arange(ORDER), coef[w], PRECISION)
    w = np.flatnonzero(ruled)
    put(at[w] + head[w] + 2, np.full(len(w), PARTS), 4)
    q = u[w] >> param[w]
    length = np.where(real[w], q + 1 + param[w], 0)
    first = (at[w] + head[w] + 6)[:, None] + np.cumsum(length, axis=1) - length + 4 * (t // (UNIT // parts) + 1)
    put(first[:, :: UNIT // parts] - 4, k[w], 4)
    f, q, p, v, ok = first.ravel(), q.ravel(), param[w].ravel(), u[w].ravel(), real[w].ravel()
    f, q, p, v = f[ok], q[ok], p[ok], v[ok]
    bits[f + q] = 1
    for b in range(int(p.max(initial=0))):
        has = p > b
        bits[(f + q + p - b)[has]] = (v[has] >> b) & 1
    out = np.packbits(bits)
    for i, b in enumerate(names):
        out[start[i] : start[i] + 4 + len(b)] = np.frombuffer(b"\xff\xf8\x20\x02" + b, np.uint8)
    out[start[:-1] + header - 1] = crc(_right_aligned(out, start[:-1], header - 1), 8, 0x07)
    c = crc(_right_aligned(out, start[:-1], size - 2))
    out[start[1:] - 2], out[start[1:] - 1] = c >> 8, c & 255
    data = out.tobytes()
    return [data[a:b] for a, b in zip(start[:-1], start[1:])]


def _head(frames: list[bytes], pcm: bytes) -> bytes:
    """Marker, STREAMINFO, and a table of seek points where there is more than one block."""
    sizes = list(map(len, frames))
    info = UNIT.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(pcm)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    at, points = 0, b""
    for i, s in enumerate(sizes):
        if i % BLOCK_FRAMES == 0:
            points += (i * UNIT).to_bytes(8, "big") + at.to_bytes(8, "big") + UNIT.to_bytes(2, "big")
        at += s
    if len(sizes) <= BLOCK_FRAMES:
        return b"fLaC\x80\x00\x00\x22" + info
    return b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose sizes are multiples of UNIT; byte b is the sample b - 128."""
    counts = [len(p) // UNIT for p in payloads]
    numbers = [i for n in counts for i in range(n)]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
    frames = [f for a in range(0, len(x), LANES) for f in encode_frames(x[a : a + LANES], numbers[a : a + LANES])]
    out, at = [], 0
    for p, n in zip(payloads, counts):
        mine = frames[at : at + n]
        at += n
        out.append(_head(mine, (np.frombuffer(p, np.uint8) ^ 128).tobytes()) + b"".join(mine))
    return out


class Damaged(ValueError):
    """What is wrong with a stream."""


def _stream(s: bytes) -> tuple[int, int, int, bytes, int, int]:
    """bits, channels, samples, MD5, largest frame and first frame's place of a stream."""
    if s[:4] != b"fLaC" or len(s) < 42 or s[4] & 127:
        raise Damaged("no stream head")
    packed = int.from_bytes(s[18:26], "big")
    at, last = 4, False
    while not last:
        if at + 4 > len(s):
            raise Damaged("head cut off")
        last, at = s[at] >> 7 == 1, at + 4 + int.from_bytes(s[at + 1 : at + 4], "big")
    return (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1, s[26:42], int.from_bytes(s[15:18], "big"), at


@lru_cache(maxsize=4096)
def _frame(h: bytes) -> tuple[int, int, int, int, int] | None:
    """block size, bits (0: the stream's), channel code, number (of the first sample if variable, then negative less 1) and header length; None if it is no header."""
    if len(h) < 6 or h[3] & 1:
        return None
    block, rate, size = h[2] >> 4, h[2] & 15, h[3] >> 1 & 7
    lead, more = h[4], 0
    while more < 8 and lead >> (7 - more) & 1:
        more += 1
    more -= more > 0
    if more == 7 or lead in range(0x80, 0xC0) or block == 0 or rate == 15 or h[3] >> 4 > 10 or size in (3, 7):
        return None
    number, at = lead if not more else lead & ((1 << (6 - more)) - 1), 5
    for b in h[5 : 5 + more]:
        number = number << 6 | b & 63
    at += more
    wide = {6: 1, 7: 2}.get(block, 0)
    n = _BLOCKS.get(block) or int.from_bytes(h[at : at + wide], "big") + 1
    at += wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if at >= len(h) or int(crc(np.frombuffer(h[:at], np.uint8)[None], 8, 0x07)[0]) != h[at]:
        return None
    return n, _SIZES.get(size, 0), h[3] >> 4, -number - 1 if h[1] & 1 else number, at + 1


class _Bits:
    """Bit positions, one for each lane, in one buffer."""

    def __init__(self, buf: np.ndarray, pos: np.ndarray) -> None:
        wide = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(_U64)
        n = len(buf) + 8
        self.win = sum(wide[k : n + k] << _U64(56 - 8 * k) for k in range(8))  # the 64 bits from each byte on
        self.pos, self.end, self.ok = pos.astype(np.int64), len(buf) * 8, np.ones(len(pos), bool)

    def look(self, at: np.ndarray) -> np.ndarray:
        return self.win[np.minimum(at >> 3, len(self.win) - 1)] << (at & 7).astype(_U64)

    def read(self, lanes: np.ndarray | slice, width: np.ndarray | int, signed: bool = False) -> np.ndarray:
        """Up to 57 bits of each lane."""
        at = self.pos[lanes]
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        v = ((self.look(at) >> _U64(1)) >> (63 - width).astype(_U64)).astype(np.int64)
        self.pos[lanes] = at + width
        return np.where((width > 0) & (v >> np.maximum(width - 1, 0) & 1 == 1), v - (np.int64(1) << width), v) if signed else v

    def unary(self, lanes: np.ndarray | slice) -> np.ndarray:
        """Zeros before the next one, which is passed too."""
        at = self.pos[lanes]
        w = self.look(at) & _U64(0xFFFFFFFFFFFFF800)  # 53 bits convert without rounding
        q = 63 - ((w.astype(np.float64).view(np.int64) >> 52) - 1023)
        if (w == 0).any():
            q, todo = np.where(w == 0, 0, q), np.flatnonzero(w == 0)
            while len(todo):
                q[todo] += 53
                w = self.look(at[todo] + q[todo]) & _U64(0xFFFFFFFFFFFFF800)
                found = w != 0
                q[todo[found]] += 63 - ((w[found].astype(np.float64).view(np.int64) >> 52) - 1023)
                todo = todo[~found & (at[todo] + q[todo] < self.end)]
        self.pos[lanes] = at + q + 1
        return q


    def rice(self, lanes: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Zeros before the next one, then k bits: from one look where both fit it."""
        at = self.pos[lanes]
        w = self.win[np.minimum(at >> 3, len(self.win) - 1)] << (at & 7).view(_U64)
        q = 1086 - ((w & _U64(0xFFFFFFFFFFFFF800)).astype(np.float64).view(np.int64) >> 52)
        used = q + 1 + k
        if used.max(initial=0) > 57:  # no one in sight, or its low bits beyond
            return self.unary(lanes) << k | self.read(lanes, k)
        self.pos[lanes] = at + used
        return q << k | ((w << (q + 1).view(_U64) >> _U64(1)) >> (63 - k).view(_U64)).view(np.int64)


def _residuals(bits: _Bits, lanes: np.ndarray, order: np.ndarray, out: np.ndarray) -> None:
    """Rice-coded residuals of ``lanes`` into ``out`` (samples, lanes)."""
    n = len(out)
    method, po = bits.read(lanes, 2), bits.read(lanes, 4)
    part = n >> po
    bits.ok[lanes[(method > 1) | (part < order) | (part << po != n)]] = False
    part = np.maximum(part, 1)
    wide, k, raw = 4 + (method & 1), np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    starts = set(order.tolist()) | {i for p in np.unique(part).tolist() for i in range(0, n, p)}
    escapes = False
    for t in range(n):
        on = np.flatnonzero(order <= t) if t < 32 else slice(None)
        if t in starts:
            new = np.flatnonzero((order == t) | ((order < t) & (t % part == 0)))
            for again in (new, new[(order[new] == t) & (part[new] == t) & (t > 0)]):  # a first partition of warm-up samples alone
                k[again] = bits.read(lanes[again], wide[again])
                esc = again[k[again] == (1 << wide[again]) - 1]
                raw[again] = 0
                if len(esc):
                    escapes, raw[esc] = True, bits.read(lanes[esc], 5) + 64  # 64: a mark
        who = lanes[on]
        if escapes and (raw[on] > 0).any():
            idx = np.arange(len(lanes))[on]
            e, c = idx[raw[idx] > 0], idx[raw[idx] == 0]
            out[t, e] = bits.read(lanes[e], raw[e] - 64, signed=True)
            u = bits.rice(lanes[c], k[c])
            out[t, c] = (u >> 1) ^ -(u & 1)
        elif len(who):
            u = bits.rice(who, k[on])
            out[t, on] = (u >> 1) ^ -(u & 1)


def _subframes(bits: _Bits, n: int, depth: int) -> np.ndarray:
    """The next subframe of every lane: samples (n, lanes)."""
    every = np.arange(len(bits.pos))
    head = bits.read(every, 8)
    kind, wasted = head >> 1 & 63, np.zeros(len(every), np.int64)
    w = np.flatnonzero(head & 1)
    wasted[w] = bits.unary(w) + 1
    deep = np.maximum(depth - wasted, 1)
    order = np.select([kind >= 32, kind >= 8], [kind - 31, kind - 8], 0)
    ruled = kind >= 8
    bits.ok &= (head < 128) & ((kind <= 1) | (ruled & ((kind >= 32) | (order <= 4))))
    bits.ok &= order <= n
    order = np.where(bits.ok, order, 0)
    s = np.zeros((n, len(every)), np.int64)
    w = np.flatnonzero(kind == 0)
    s[:, w] = bits.read(w, deep[w], signed=True)
    w = np.flatnonzero(kind == 1)
    if len(w):
        at = bits.pos[w] + np.arange(n)[:, None] * deep[w]
        v = (bits.look(at) >> (64 - deep[w]).astype(_U64)).astype(np.int64)
        s[:, w] = np.where(v >> (deep[w] - 1) & 1, v - (np.int64(1) << deep[w]), v)
        bits.pos[w] += n * deep[w]
    w = np.flatnonzero(ruled & bits.ok)
    if len(w):
        o, most = order[w], int(order[w].max())
        for t in range(most):
            on = w[o > t]
            s[t, on] = bits.read(on, deep[on], signed=True)
        coef, shift = np.zeros((most, len(w)), np.int64), np.zeros(len(w), np.int64)
        lpc = kind[w] >= 32
        lin = w[lpc]
        wide = bits.read(lin, 4) + 1
        shift[lpc] = bits.read(lin, 5, signed=True)
        bits.ok[lin[(wide == 16) | (shift[lpc] < 0)]] = False
        for j in range(most):
            on = np.flatnonzero(lpc & (o > j))
            coef[j, on] = bits.read(w[on], wide[np.searchsorted(lin, w[on])], signed=True)
            for f in range(j + 1, 5):
                coef[j, ~lpc & (o == f)] = _FIXED[f][j]
        shift = np.maximum(shift, 0)
        r = np.zeros((n, len(w)), np.int64)
        _residuals(bits, w, o, r)
        v = s[:, w]
        for t in range(n):
            m = min(t, most)
            p = (np.einsum("jl,jl->l", coef[:m], v[t - m : t][::-1]) >> shift) + r[t] if m else r[t]
            v[t] = np.where(o <= t, p, v[t]) if t < most else p
        s[:, w] = v
    return s << wasted


def _decode(buf: np.ndarray, begin: np.ndarray, header: np.ndarray, n: int, depth: int, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (n, channels, lanes), ends and soundness of frames of one form."""
    bits = _Bits(buf, (begin + header) * 8)
    sides = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(code, (0,) * (code + 1))
    ch = [_subframes(bits, n, depth + extra) for extra in sides]
    if code == 8:
        ch[1] = ch[0] - ch[1]
    elif code == 9:
        ch[0] = ch[0] + ch[1]
    elif code == 10:
        mid = ch[0] * 2 + (ch[1] & 1)
        ch = [(mid + ch[1]) >> 1, (mid - ch[1]) >> 1]
    end = (bits.pos + 7) // 8 + 2
    sound = bits.ok & (end <= len(buf))
    size = np.where(sound, end - begin, 0)
    sound &= crc(_right_aligned(buf, begin, size)) == 0  # a frame with its CRC leaves nothing
    return np.stack(ch, axis=1), end, sound


def decode(streams: list[bytes | None]) -> Iterator[tuple[list[tuple[int, int, bytes]], str | None]]:
    """For each stream its frames (byte, samples, PCM) and what is wrong with it: None, or a text and no frames."""
    infos: list = []
    lanes: dict[tuple[int, int, int], list[tuple[int, int, int, int, int]]] = {}
    for i, s in enumerate(streams):
        try:
            if s is None:
                raise Damaged("no stream")
            infos.append(_stream(s))
            a = np.frombuffer(s, np.uint8)
            for at in np.flatnonzero((a[infos[-1][5] : -1] == 0xFF) & (a[infos[-1][5] + 1 :] & 0xFE == 0xF8)).tolist():
                at += infos[-1][5]
                f = _frame(s[at : at + 16]) if len(s) - at < 16 else _frame(s[at : at + 5] + s[at + 5 : at + 16]) if s[at + 4] >= 0x80 or s[at + 2] >> 4 in (6, 7) or s[at + 2] & 15 > 11 else _frame(s[at : at + 6])
                if f:
                    n, bits, code, number, long = f
                    most = n * (code + 1 if code < 8 else 2) * 8 + 1024
                    lanes.setdefault((n, bits or infos[-1][0], code), []).append((i, at, number, long, min(infos[-1][4] or most, most)))
        except Damaged as e:
            infos.append(str(e))
    found: list[dict[int, tuple[int, int, int, bytes]]] = [{} for _ in streams]
    for (n, depth, code), all_of in lanes.items():
        for a in range(0, len(all_of), max(1, LANES * UNIT // n)):
            some = all_of[a : a + max(1, LANES * UNIT // n)]
            cuts = [streams[i][at : at + most] for i, at, _, _, most in some]
            begin = np.concatenate([[0], np.cumsum([len(c) + 16 for c in cuts])[:-1]]).astype(np.int64)
            buf = np.frombuffer((b"\0" * 16).join(cuts), np.uint8)
            pcm, end, sound = _decode(buf, begin, np.array([x[3] for x in some]), n, depth, code)
            flat = np.ascontiguousarray(pcm.transpose(2, 0, 1).reshape(len(some), -1))
            wide = (depth + 7) // 8
            raw = flat.astype("<i4").view(np.uint8).reshape(len(some), -1, 4)[:, :, :wide].reshape(len(some), -1)
            for x, e, ok, b, row in zip(some, (end - begin).tolist(), sound.tolist(), begin, raw):
                if ok:
                    found[x[0]][x[1]] = (x[1] + e, x[2], n, row.tobytes())
    for s, info, mine in zip(streams, infos, found):
        if isinstance(info, str):
            yield [], info
            continue
        _, _, total, md5, _, at = info
        out, samples, index, wrong, digest = [], 0, 0, None, hashlib.md5()
        while at < len(s) and (not total or samples < total):
            if at not in mine or mine[at][1] not in (index, -samples - 1):
                wrong = f"no sound frame at byte {at}"
                break
            end, _, n, pcm = mine[at]
            out.append((at, n, pcm))
            digest.update(pcm)
            at, samples, index = end, samples + n, index + 1
        if not wrong and total and samples != total:
            wrong = f"{samples} samples instead of {total}"
        if not wrong and any(md5) and digest.digest() != md5:
            wrong = "the samples' MD5 differs"
        yield ([], wrong) if wrong else (out, None)


def _chunks(streams: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes, or of one row."""
    a, held = 0, 0
    for i, s in enumerate(streams):
        if i > a and held + len(s or b"") > most:
            yield a, i
            a, held = i, 0
        held += len(s or b"")
    if a < len(streams):
        yield a, len(streams)


_BLOCK = [("block", pa.int32()), ("sample_offset", pa.int64()), ("samples", pa.int32()), ("byte_offset", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())]


def _blocks(batches: Iterator[pa.RecordBatch], media: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``pcm_blocks``."""
    for batch in batches:
        streams = batch.column(media).to_pylist()
        for a, b in _chunks(streams, LANES * UNIT):
            rows, of = [], []
            for i, (frames, wrong) in enumerate(decode(streams[a:b])):
                at = 0
                for k in range(0, max(len(frames), 1), BLOCK_FRAMES):
                    some = frames[k : k + BLOCK_FRAMES]
                    n = sum(f[1] for f in some)
                    rows.append((k // BLOCK_FRAMES, at, n, some[0][0] if some else None, b"".join(f[2] for f in some), wrong))
                    of.append(a + i)
                    at += n
            cols = [batch.column(c).take(pa.array(of, pa.int64())) for c in keep]
            cols += [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(_BLOCK)]
            yield pa.RecordBatch.from_arrays(cols, keep + [c for c, _ in _BLOCK])


def _kinds(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keep)


def store(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with n_bytes, payload_bytes and media: the text's UTF-8, padded by 255 to a positive multiple of UNIT, as FLAC."""
    small_batches(df.sparkSession)
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            for a, b in _chunks(texts, LANES * UNIT):
                payloads = [t + b"\xff" * (-len(t) % UNIT or (0 if t else UNIT)) for t in texts[a:b]]
                cols = [batch.column(c).slice(a, b - a) for c in keep]
                cols += [pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.array(encode(payloads), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_bytes", "payload_bytes", "media"])

    return spread(df.select(*keep, whole_text(text).alias("_text"))).mapInArrow(run, f"{_kinds(df, keep)}, n_bytes long, payload_bytes long, media binary")


def pcm_blocks(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with block, sample_offset, samples, byte_offset, pcm (signed, little-endian, interleaved) and error."""
    small_batches(df.sparkSession)
    keep = keep or ["doc_id"]
    return df.select(*keep, media).mapInArrow(
        lambda it: _blocks(it, media, keep), f"{_kinds(df, keep)}, block int, sample_offset long, samples int, byte_offset long, pcm binary, error string"
    )


def pcm_range(blocks: DataFrame, key: str, first: int, count: int, width: int = 1) -> DataFrame:
    """key and pcm of ``count`` samples from ``first`` on (``width`` bytes each, channels together): only the blocks that hold them are read."""
    stop = F.col("sample_offset") + F.col("samples")
    met = blocks.where((F.col("sample_offset") < first + count) & (stop > first) & F.col("error").isNull())
    skip = F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0))
    part = F.substring("pcm", (skip * width + 1).cast("int"), ((F.least(stop, F.lit(first + count)) - F.col("sample_offset") - skip) * width).cast("int"))
    # a span of samples is of a bounded number of blocks
    met = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample_offset", part.alias("part")))).alias("_p"))
    return met.select(key, F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("pcm"))


class _Features:
    """Digests and integer features of 8-bit samples, block by block."""

    def __init__(self) -> None:
        self.sha, self.tail, self.n, self.total, self.square, self.turns, self.peak, self.last = hashlib.sha256(), b"", 0, 0, 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.int8).astype(np.int64)
        if not len(x):
            return
        payload = (np.frombuffer(pcm, np.uint8) ^ 128).tobytes()
        self.sha.update(payload)
        self.tail = (self.tail + payload[-32:])[-32:]
        up = x >= 0
        self.turns += int((up[1:] != up[:-1]).sum()) + int(self.last is not None and self.last != up[0])
        self.n, self.total, self.square, self.peak, self.last = self.n + len(x), self.total + int(x.sum()), self.square + int((x * x).sum()), max(self.peak, int(np.abs(x).max())), up[-1]

    def row(self) -> tuple[str, int, str]:
        rms = math.isqrt(self.square // max(self.n, 1))
        return self.sha.hexdigest(), zlib.crc32(self.tail), f"samples={self.n} sum={self.total} rms={rms} crossings={self.turns} peak={self.peak}"


def features(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, blocks, error of stored texts.

    A stream's blocks follow each other in their task and are folded as they are decoded: no block leaves it.
    """
    small_batches(df.sparkSession)
    keep = ["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256"]
    df = df.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    out = [*keep, "payload_sha256", "tail_crc32", "feature", "blocks", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, schema = [], None, None

        def close() -> None:
            kept, f, blocks, wrong = now
            held.append((*kept, *(f.row() if wrong is None else (None, None, None)), blocks, wrong))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held))
            kinds = [*schema, pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], out)

        for batch in _blocks(batches, "media", keep):
            schema = [batch.column(c).type for c in keep]
            kept = list(zip(*(batch.column(c).to_pylist() for c in keep)))
            for i, (block, pcm, wrong) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "pcm", "error")))):
                if block == 0:
                    if now:
                        close()
                    now = (kept[i], _Features(), 0, wrong)
                now[1].add(pcm)
                now = (*now[:2], now[2] + 1, now[3])
            if len(held) >= 1024:
                yield flush()
                held.clear()
        if now:
            close()
        if held:
            yield flush()

    kinds = f"{_kinds(df, keep)}, payload_sha256 string, tail_crc32 long, feature string, blocks int, error string"
    return df.select(*keep, "media").mapInArrow(run, kinds)


def op12_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))


QUERIES = {"op12_media": op12_media}
SQL: dict[str, str] = {}
