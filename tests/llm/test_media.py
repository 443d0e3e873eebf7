"""FLAC columns: round trips, an independent writer of other forms, and damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from rankwright.llm import media as me


def texts():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "été", "日本", "\U0001f600", "12,5", "\n\n", "==="]
    out = [None, "", "a", "x" * 576, "x" * 577, "\x00" * 100, "zero\x00mid", "ÿø " * 700]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(12)]
    out += ["".join(chr(rng.randrange(1, 0xD800)) for _ in range(3000)), "long text " * 30_000]  # over 500 frames: frame numbers of two bytes, many blocks
    return [*out, *out[8:11]]


def payload(t):
    b = (t or "").encode()
    return b + b"\xff" * (-len(b) % 576 or (0 if b else 576))


class Writer:
    """A plain bit-by-bit FLAC writer, with forms that the operator's encoder never uses."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [(v >> (n - 1 - i)) & 1 for i in range(n)]

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8))


def plain_crc(data, bits, poly):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
    return c


def write_residual(w, res, order, n, po, method, rng, escape):
    w.put(method, 2)
    w.put(po, 4)
    part, wide, at = n >> po, 4 + method, 0
    for p in range(1 << po):
        mine = res[at : at + (part - order if p == 0 else part)]
        at += len(mine)
        if escape and rng.random() < 0.5:
            raw = max((max(v, -v - 1).bit_length() + 1 for v in mine), default=0) if any(mine) else 0
            w.put((1 << wide) - 1, wide)
            w.put(raw, 5)
            for v in mine:
                w.put(v & ((1 << raw) - 1), raw)
            continue
        most = max(map(abs, mine), default=0)
        k = min((1 << wide) - 2, max(0, most.bit_length() - rng.choice([0, 1, 3, 5])))  # up to 60 zeros in a row
        w.put(k, wide)
        for v in mine:
            u = v * 2 if v >= 0 else -v * 2 - 1
            w.put(0, u >> k)
            w.put(1, 1)
            w.put(u & ((1 << k) - 1), k)


def write_subframe(w, x, depth, rng):
    n = len(x)
    waste = 0
    while waste < depth - 1 and any(x) and all(v % (2 << waste) == 0 for v in x):
        waste += 1
    forms = ["plain", "fixed", "lpc"] + ["flat"] * (len(set(x)) == 1)
    form = rng.choice(forms)
    order = rng.choice([0, 1, 2, 3, 4]) if form == "fixed" else rng.choice([1, 2, 7, 12]) if form == "lpc" else 0
    if n <= order:
        form, order = "plain", 0
    w.put(0, 1)
    w.put({"flat": 0, "plain": 1, "fixed": 8 + order, "lpc": 31 + order}[form], 6)
    w.put(int(waste > 0), 1)
    if waste:
        w.put(1, waste)
    x, depth = [v >> waste for v in x], depth - waste
    sign = lambda v, b: v & ((1 << b) - 1)
    if form == "flat":
        return w.put(sign(x[0], depth), depth)
    for v in x if form == "plain" else x[:order]:
        w.put(sign(v, depth), depth)
    if form == "plain":
        return None
    if form == "fixed":
        coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
    else:
        precision, shift = rng.choice([3, 9, 15]), rng.choice([1, 3, 6])
        coef = [rng.randint(-2, 2) for _ in range(order)]
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for c in coef:
            w.put(sign(c, precision), precision)
    res = [x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(coef)) >> shift) for t in range(order, n)]
    po = max(p for p in (0, rng.choice([0, 1, 2, 3])) if n % (1 << p) == 0 and n >> p >= order)
    write_residual(w, res, order, n, po, rng.choice([0, 1]) if max(map(abs, res), default=0) < 1 << 17 else 1, rng, rng.random() < 0.4)


def write_stream(channels, depth, block, code, variable, rng, md5=True):
    """A FLAC stream of channels of equal length, by the plain rules of the format."""
    total, wide, body, sizes = len(channels[0]), (depth + 7) // 8, b"", []
    for f, a in enumerate(range(0, total, block)):
        part = [c[a : a + block] for c in channels]
        n = len(part[0])
        w = Writer()
        w.put(0x3FFE, 14)
        w.put(0, 1)
        w.put(int(variable), 1)
        size = {192: 1, 576: 2, 1152: 3, 256: 8}.get(n)
        w.put(size or 7, 4)
        w.put(rng.choice([0, 12, 14]), 4)
        rate = int("".join(map(str, w.bits[20:24])), 2)
        w.put(code, 4)
        w.put({8: 1, 12: 2, 16: 4, 24: 6}[depth] if rng.random() < 0.5 else 0, 3)
        w.put(0, 1)
        number = a if variable else f
        for b in me._number(number):
            w.put(b, 8)
        if not size:
            w.put(n - 1, 16)
        if rate:
            w.put(44, 8 if rate == 12 else 16)
        w.put(plain_crc(w.bytes(), 8, 0x07), 8)
        depths = [depth] * len(part)
        if code == 8:
            part, depths[1] = [part[0], [p - q for p, q in zip(*part)]], depth + 1
        elif code == 9:
            part, depths[0] = [[p - q for p, q in zip(*part)], part[1]], depth + 1
        elif code == 10:
            part, depths[1] = [[(p + q) >> 1 for p, q in zip(*part)], [p - q for p, q in zip(*part)]], depth + 1
        for x, d in zip(part, depths):
            write_subframe(w, x, d, rng)
        data = w.bytes()
        body += data + plain_crc(data, 16, 0x8005).to_bytes(2, "big")
        sizes.append(len(data) + 2)
    pcm = b"".join(v.to_bytes(wide, "little", signed=True) for vs in zip(*channels) for v in vs)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (len(channels) - 1) << 41 | (depth - 1) << 36 | total).to_bytes(8, "big")
    info += hashlib.md5(pcm).digest() if md5 else bytes(16)
    return b"fLaC\x00\x00\x00\x22" + info + b"\x84\x00\x00\x05hello" + body, pcm


def test_crc_agrees_with_the_plain_one():
    rng = random.Random(1)
    for n in (1, 2, 9, 600, 1152, 1153, 2304, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        row = np.frombuffer(data, np.uint8)[None]
        assert int(me.crc(row)[0]) == plain_crc(data, 16, 0x8005)
        assert int(me.crc(row, 8, 0x07)[0]) == plain_crc(data, 8, 0x07)


@pytest.mark.parametrize("depth, code, block, variable", [(8, 0, 576, False), (16, 1, 192, False), (16, 8, 1152, False), (16, 9, 300, True), (24, 10, 256, False), (12, 10, 192, True), (8, 2, 100, False), (16, 10, 40, False)])
def test_streams_of_another_writer(depth, code, block, variable):
    rng = random.Random(depth * 100 + code)
    n = block * 3 + 17
    channels = []
    top = (1 << (depth - 1)) - 1
    for c in range(code + 1 if code < 8 else 2):
        x = [int(top * 0.6 * np.sin(t / (7 + c)) + rng.randint(-20, 20)) for t in range(n)]
        x[block : 2 * block] = [v & ~3 for v in x[block : 2 * block]] if c % 2 == 0 else [5] * block
        channels.append([max(-top, min(top, v)) for v in x])
    made = [write_stream(channels, depth, block, code, variable, random.Random(s), s % 2 == 0) for s in range(6)]
    for (_, pcm), (frames, wrong) in zip(made, me.decode([s for s, _ in made])):
        assert wrong is None and b"".join(f[2] for f in frames) == pcm


def test_every_stream_comes_back_and_is_the_same_in_any_batch():
    ps = [payload(t) for t in texts()] + [random.Random(4).randbytes(576 * 5), bytes([255, 248, 32, 2]) * 144 * 3, bytes(576), bytes([0, 255]) * 288 * 3]
    streams = me.encode(ps)
    assert streams == [me.encode([p])[0] for p in ps]
    for p, (frames, wrong) in zip(ps, me.decode(streams)):
        assert wrong is None and bytes(b ^ 128 for f in frames for b in f[2]) == p
        assert [n for _, n, _ in frames] == [576] * (len(p) // 576)
    assert len(streams[21]) < 0.9 * len(ps[21])  # plain ASCII


def test_sync_codes_inside_a_frame_mislead_nobody():
    """Whole frames, headers and checksums included, as samples of plain frames."""
    inner = b"".join(me.encode_frames(np.full((40, 576), 9, np.int16), list(range(40))))
    rng = random.Random(6)
    p = b"".join(rng.randbytes(3) + bytes(b ^ 128 for b in inner[a : a + 90]) for a in range(0, len(inner), 90))
    p += b"\xff" * (-len(p) % 576)
    (frames, wrong), = me.decode(me.encode([p]))
    assert wrong is None and bytes(b ^ 128 for f in frames for b in f[2]) == p


def test_any_damage_is_noticed():
    s = me.encode([payload("some text that is stored, " * 60)])[0]
    rng = random.Random(8)
    bad = [None, b"", b"fLaC", s[:-1], s[: len(s) // 2], s[:42] + s[600:], b"x" + s[1:]]
    for _ in range(150):
        i = rng.randrange(42 if rng.random() < 0.8 else 22, len(s))
        bad.append(s[:i] + bytes([s[i] ^ 1 << rng.randrange(8)]) + s[i + 1 :])
    for b, (frames, wrong) in zip(bad, me.decode(bad)):
        assert wrong and not frames, b


def test_blocks_and_ranges_by_offset(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(texts())] + [(3, "twice", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, media string, block int")
    stored = me.store(df, keep=["doc_id"])
    damaged = stored.selectExpr("doc_id", "if(doc_id = 9, substring(media, 1, 200), if(doc_id = 8, null, media)) as media")
    blocks = me.pcm_blocks(damaged).collect()
    assert {r.doc_id for r in blocks if r.error} == {8, 9} and all(r.samples == 0 and r.pcm == b"" for r in blocks if r.error)
    whole = sorted((r for r in blocks if r.doc_id == 21), key=lambda r: r.block)  # the long text
    assert b"".join(r.pcm for r in whole) == bytes(b ^ 128 for b in payload(rows[21][1])) and len(whole) > 5
    assert [r.sample_offset for r in whole] == [i * 64 * 576 for i in range(len(whole))]
    media = {r.doc_id: r.media for r in stored.collect()}
    assert all(media[21][r.byte_offset : r.byte_offset + 2] == b"\xff\xf8" for r in whole)
    table = spark.createDataFrame(blocks)
    for first, count in ((0, 10), (36_860, 10), (30_000, 80_000), (299_000, 10_000)):
        got = {r.doc_id: r.pcm for r in me.pcm_range(table.where("doc_id = 21"), "doc_id", first, count).collect()}
        assert got[21] == b"".join(r.pcm for r in whole)[first : first + count]


def features_of(t):
    p = payload(t)
    x = [b - 128 for b in p]
    rms = int(sum(v * v for v in x) // len(x))
    turns = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    import math

    feature = f"samples={len(x)} sum={sum(x)} rms={math.isqrt(rms)} crossings={turns} peak={max(map(abs, x))}"
    return len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), feature


def check(got, rows):
    kept = {}
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))):
        want = [features_of(u) for j, u in rows if j == i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) in want and r.error is None
        assert r.media_bytes < r.payload_bytes + 42 + 12 * (r.payload_bytes // 576) + 22 + 18 * (r.payload_bytes // 36864 + 1)
        assert kept.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256)) == (r.media_bytes, r.media_sha256)
    assert len(got) == len(rows)


def test_features_of_odd_and_empty_tables(spark, odd, empty):
    check(me.features(me.store(odd)).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert me.features(me.store(empty)).collect() == [] == me.pcm_blocks(me.store(empty)).collect()
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    check(me.features(me.store(df)).collect(), list(enumerate(texts())))


def test_query_agrees_with_plain_python(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(me.op12_media(spark, sf).collect(), rows)
