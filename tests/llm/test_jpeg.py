import hashlib
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from helpers import no_docs, odd_docs
from pyspark.sql import functions as F

from tessera.llm import jpeg


def test_query_round_trip(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = jpeg.op10_progressive_jpeg(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        payload = jpeg.padded(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(docs[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(jpeg.encode(payload)).hexdigest()


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 384, 4000, 64 * 6 * 65, 64 * 6 * 300 + 5, 64 * 6 * 9000])
def test_every_byte_comes_back(size):
    payload = jpeg.padded(random.Random(size).randbytes(size))
    assert len(payload) % 64 == 0 and payload
    assert jpeg.payload_of(jpeg.Decoder(jpeg.encode(payload))) == payload


class Writer:
    """A plain progressive encoder, coefficient by coefficient, with run lengths and end-of-band runs: the decoder's other way."""

    def __init__(self):
        self.bits, self.syms = [], []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 9)  # every symbol has the nine-bit code of its number

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def shifted(v, low):
    return int(np.sign(v)) * (abs(int(v)) >> low)


def size_of(v):
    return abs(v).bit_length()


def put_value(w, v):
    n = size_of(v)
    w.put(v if v > 0 else v + (1 << n) - 1, n)


def ac_first(blocks, first, last, low):
    w, run = Writer(), 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = shifted(b[k], low)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | size_of(v))
            put_value(w, v)
            zeros = 0
        if zeros:
            run += 1
    flush()
    return w.done()


def ac_refine(blocks, first, last, low):
    w = Writer()
    for b in blocks:
        zeros, held = 0, []
        new = [k for k in range(first, last + 1) if abs(int(b[k])) >> low == 1]
        end = max(new, default=first - 1)
        for k in range(first, end + 1):
            m = abs(int(b[k])) >> low
            if m > 1:
                held.append(m & 1)
            elif m == 1:
                w.symbol(zeros << 4 | 1)
                w.put(int(b[k] > 0), 1)
                w.bits += held
                zeros, held = 0, []
            else:
                if zeros == 15:
                    w.symbol(0xF0)
                    w.bits += held
                    held, zeros = [], 0
                    continue
                zeros += 1
        if end < last:
            w.symbol(0)
            w.bits += held + [abs(int(b[k])) >> low & 1 for k in range(end + 1, last + 1) if abs(int(b[k])) >> low > 1]
    return w.done()


def plain_jpeg(comps, width, height, restart=0):
    """comps: (h, v, quant, grid of blocks); DC in two steps, AC in bands and three steps of precision."""
    hmax, vmax = max(c[0] for c in comps), max(c[1] for c in comps)
    out = [b"\xff\xd8"]
    out += [jpeg._segment(0xDB, bytes([n]) + bytes(q.tolist())) for n, (_, _, q, _) in enumerate(comps)]
    out.append(jpeg._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(comps)) + b"".join(bytes([n + 1, h << 4 | v, n]) for n, (h, v, _, _) in enumerate(comps))))
    out += [jpeg._huffman(k, 0, {9: list(range(250))}) for k in (0, 1)]
    rows, cols = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    if restart:
        out.append(jpeg._segment(0xDD, struct.pack(">H", restart)))
    mcus = [[(n, g[r * v + i, c * h + j]) for n, (h, v, _, g) in enumerate(comps) for i in range(v) for j in range(h)] for r in range(rows) for c in range(cols)]
    if len(comps) == 1:
        h, v, _, g = comps[0]
        mcus = [[(0, g[r, c])] for r in range(-(-height // 8)) for c in range(-(-width // 8))]
    head = bytes([len(comps)]) + b"".join(bytes([n + 1, 0]) for n in range(len(comps)))
    for high, low in ((0, 1), (1, 0)):
        out.append(jpeg._segment(0xDA, head + bytes([0, 0, high << 4 | low])))
        parts = [mcus[a : a + restart] for a in range(0, len(mcus), restart)] if restart else [mcus]
        for i, part in enumerate(parts):
            w, last = Writer(), [0] * len(comps)
            for n, b in (x for m in part for x in m):
                if high:
                    w.put(int(b[0]) & 1, 1)
                else:
                    d = (int(b[0]) >> 1) - last[n]
                    last[n] = int(b[0]) >> 1
                    w.symbol(size_of(d))
                    if d:
                        put_value(w, d)
            out.append((b"\xff" + bytes([0xD0 + (i - 1) % 8]) if i else b"") + w.done())
    if restart:
        out.append(jpeg._segment(0xDD, struct.pack(">H", 0)))
    for n, (h, v, _, g) in enumerate(comps):
        own = g[: -(-(-(-height * v // vmax)) // 8), : -(-(-(-width * h // hmax)) // 8)].reshape(-1, 64)
        for first, last in ((1, 9), (10, 63)):
            out += [jpeg._segment(0xDA, bytes([1, n + 1, 0, first, last, 0x02])), ac_first(own, first, last, 2)]
        for high, low in ((2, 1), (1, 0)):
            out += [jpeg._segment(0xDA, bytes([1, n + 1, 0, 1, 63, high << 4 | low])), ac_refine(own, 1, 63, low)]
    return b"".join([*out, b"\xff\xd9"])


def sparse(rng, rows, cols):
    g = np.zeros((rows, cols, 64), np.int64)
    g[:, :, 0] = rng.integers(-500, 500, (rows, cols))
    mask = rng.random((rows, cols, 63)) < rng.choice([0.02, 0.3, 0.9], (rows, cols, 1))
    g[:, :, 1:] = np.where(mask, rng.integers(-40, 40, (rows, cols, 63)), 0)
    return g


@pytest.mark.parametrize("shape", [(((1, 1),), 24, 17, 0), (((2, 2), (1, 1), (1, 1)), 45, 39, 0), (((2, 1), (1, 1), (1, 1)), 33, 20, 2), (((1, 1), (1, 1), (1, 1)), 16, 16, 1)])
def test_decoder_reads_any_progressive_stream(shape):
    factors, width, height, restart = shape
    rng = np.random.default_rng(5)
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    rows, cols = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    comps = [(h, v, rng.integers(1, 4, 64), sparse(rng, rows * v, cols * h)) for h, v in factors]
    image = jpeg.Decoder(plain_jpeg(comps, width, height, restart))
    for c, (h, v, quant, grid) in zip(image.components.values(), comps, strict=True):
        assert (c.grid[: c.rows, : c.cols] == grid[: c.rows, : c.cols]).all()
        assert (c.grid[:, :, 0] == grid[:, :, 0]).all() or len(comps) == 1
    rgb = image.rgb()
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    # the first block's luma by the textbook sum
    c, q = image.components[1], image.quants[0]
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = c.grid[0, 0] * q
    block = block.reshape(8, 8)
    cu = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    f = np.array([[sum(cu(u) * cu(v) * block[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for y in range(8)] for x in range(8)])
    want = np.clip(np.floor(f + 128.5), 0, 255)
    assert np.abs(image.planes()[0][:8, :8].astype(int) - want[: min(8, height), : min(8, width)]).max() <= 1


def slow_rgb(comps, width, height):
    """comps: (h, v, quant, grid in zigzag order): each block by the cosine sum in floating point, chroma repeated, colours by the real-valued formulas."""
    hmax, vmax = max(c[0] for c in comps), max(c[1] for c in comps)
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    planes = []
    for h, v, quant, grid in comps:
        rows, cols, _ = grid.shape
        plane = np.zeros((8 * rows, 8 * cols))
        for r in range(rows):
            for c in range(cols):
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = grid[r, c] * quant
                plane[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] = cos.T @ block.reshape(8, 8) @ cos + 128
        plane = np.clip(np.floor(plane + 0.5), 0, 255)
        planes.append(np.array([[plane[y * v // vmax, x * h // hmax] for x in range(width)] for y in range(height)]))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)


@pytest.mark.parametrize("shape", [(((1, 1),), 24, 17), (((2, 2), (1, 1), (1, 1)), 45, 39), (((2, 1), (1, 1), (1, 1)), 33, 20)])
def test_whole_images_equal_brute_force(shape):
    factors, width, height = shape
    rng = np.random.default_rng(6)
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    rows, cols = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    comps = [(h, v, rng.integers(1, 4, 64), sparse(rng, rows * v, cols * h)) for h, v in factors]
    got = jpeg.Decoder(plain_jpeg(comps, width, height, 0)).rgb().astype(float)
    off = np.abs(got - slow_rgb(comps, width, height))
    # a sample may round the other way, which the colour formulas carry on
    assert off.max() <= 3.3 and off.mean() < 0.4


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = jpeg.op10_progressive_jpeg(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for n, r in enumerate(got):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        if n < 12 and len(payload) < 3000:
            # the stored image, from the bytes alone: luma blocks MCU by MCU, then both chroma planes
            across, down = jpeg.geometry(len(payload) // 64)
            data = np.frombuffer(payload.ljust(384 * across * down, b"\0"), np.uint8).astype(int).reshape(-1, 64)
            values, mcus, one = np.where(data < 128, data - 255, data), across * down, np.ones(64, int)
            comps = [(2, 2, one, values[: 4 * mcus].reshape(2 * down, 2 * across, 64)), *[(1, 1, one, values[k * mcus : (k + 1) * mcus].reshape(down, across, 64)) for k in (4, 5)]]
            want = slow_rgb(comps, 16 * across, 16 * down)
            head, means, _ = r["feature"].split(";")
            assert head == f"{16 * down}x{16 * across}x3"
            assert np.allclose([float(x) for x in means.removeprefix("mean=").split(",")], want.mean(axis=(0, 1)), atol=0.3)


def test_small_images_take_few_calls():
    """What a text of 2 kB costs is calls: they are counted, as seconds differ by machine."""
    payload = jpeg.padded(random.Random(8).randbytes(2000))
    media = jpeg.encode(payload)
    jpeg.payload_of(jpeg.Decoder(media))  # tables of the shape are there from here on
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        again = jpeg.encode(payload)
        image = jpeg.Decoder(again)
        image.rgb()
    finally:
        sys.setprofile(None)
    assert again == media and jpeg.payload_of(image) == payload
    assert calls < 1000


def test_scans_that_no_stream_may_have_are_errors():
    good = jpeg.encode(jpeg.padded(b"some text " * 50))
    # all three components in the first scan of AC values; then DC differences of 18 bits
    for old, new in ((b"\xff\xda\0\x08\x01\x01\0\x01\x05\x01", b"\xff\xda\0\x0c\x03\x01\0\x02\0\x03\0\x01\x05\x01"), (bytes(range(10)) + b"\xff\xc4", bytes([18] * 10) + b"\xff\xc4")):
        assert good.count(old) == 1
        with pytest.raises(ValueError, match="has one component|more bits than"):
            jpeg.Decoder(good.replace(old, new))


def test_broken_media_are_reported(spark):
    good = jpeg.encode(jpeg.padded(b"some text " * 50))
    rnd = np.random.default_rng(7)
    cut = [good[:n] for n in (0, 1, 3, 20, 100, len(good) // 2, len(good) - 2)]
    spoilt = []
    for _ in range(200):
        raw = bytearray(good)
        for at in rnd.integers(2, len(raw), 3):
            raw[at] = int(rnd.integers(0, 256))
        spoilt.append(bytes(raw))
    baseline = good.replace(b"\xff\xc2", b"\xff\xc0", 1)
    media = spark.createDataFrame([(i, x) for i, x in enumerate([good, None, baseline, b"no image", *cut, *spoilt])], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in jpeg.decode(media, keep=("doc_id",)).collect()}
    assert len(got) == 11 + 200 and got[0]["error"] is None and got[0]["rgb"] and got[1]["error"] is None
    assert all(got[i]["error"] and got[i]["rgb"] is None for i in range(2, 11))
    assert all((r["error"] is None) == (r["rgb"] is not None) for i, r in got.items() if i != 1)


def test_tensors_are_stored(spark, tmp_path):
    docs = odd_docs(spark)
    media = jpeg.to_media(docs).select("doc_id", "media")
    got = jpeg.store_tensors(media, str(tmp_path / "tensors"), keep=("doc_id",)).collect()
    assert len(got) == 11
    for r, m in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["feature"])), sorted(jpeg.decode(media, keep=("doc_id", "media")).collect(), key=lambda r: (r["doc_id"] or 0, r["feature"])), strict=True):
        assert (jpeg.tensor(r) == jpeg.Decoder(bytes(m["media"])).rgb()).all()


def test_odd_and_empty(spark):
    got = jpeg.decode(jpeg.to_media(odd_docs(spark)), keep=("doc_id", "n_bytes"), digests=True).collect()
    assert len(got) == 11
    assert {r["payload_bytes"] for r in got if r["n_bytes"] == 0} == {64}
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (1, 7)}) == 1
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in got)
    assert jpeg.decode(jpeg.to_media(no_docs(spark))).collect() == []
    clash = jpeg.decode(jpeg.to_media(odd_docs(spark).withColumn("media", F.lit("m")), keep=("media", "lang")), keep=("media_kept", "lang", "n_bytes"))
    assert clash.columns == ["media_kept", "lang", "n_bytes", "height", "width", "rgb", "feature", "error"] and clash.filter("media_kept = 'm'").count() == 11
    nothing = spark.createDataFrame([(None,)], "media binary")
    assert jpeg.decode(nothing).collect()[0]["rgb"] is None
