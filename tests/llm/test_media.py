import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tests.llm.helpers import edge_texts, frame, rows
from triloom.llm import media


@pytest.mark.parametrize("text", [b"", b"abc" * 1000, bytes(range(256)) * 3, b"\xff" * 999, b"\xff\x00" * 300])
def test_roundtrip_and_general_decoder(text):
    payload = media.padded(text)
    data = media.pack_bytes(payload)
    info = media.read_avi(data)
    frames = media.decode_frames(data, info)
    assert frames.tobytes() == payload
    for i, (a, n) in enumerate(zip(info["start"].tolist(), info["size"].tolist(), strict=True)):
        assert (media.decode_jpeg(data[a : a + n]) == frames[i]).all()


def test_index_is_not_needed():
    data = media.pack_bytes(media.padded(b"x" * 1000))
    at = data.index(b"idx1")
    cut = data[:at]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert (media.decode_frames(cut) == media.decode_frames(data)).all()


class _Writer:
    def __init__(self):
        self.bits = ""

    def value(self, code, x):
        s = abs(x).bit_length()
        self.bits += code(s)
        if s:
            self.bits += format(x if x > 0 else x + (1 << s) - 1, f"0{s}b")

    def bytes(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def baseline(pixels: np.ndarray, restart: int = 0) -> bytes:
    """A grey baseline JPEG with quantisers of 1 and Huffman codes of 8 bits for every symbol."""
    h, w = pixels.shape
    symbols = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    code = {s: format(i, "08b") for i, s in enumerate(symbols)}
    dc = {s: format(s, "04b") for s in range(12)}
    dht = lambda cls, n, syms: b"\xff\xc4" + struct.pack(">HB", 19 + len(syms), cls) + bytes([len(syms) if i == n else 0 for i in range(1, 17)]) + bytes(syms)
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64) + dht(0, 4, range(12)) + dht(16, 8, symbols)
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    out += b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00" + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x00\x3f\x00"
    c = media._COS
    padded = np.pad(pixels, ((0, -h % 8), (0, -w % 8)), "edge").astype(float) - 128
    last, scan, m, wr = 0, b"", 0, _Writer()
    for y in range(0, padded.shape[0], 8):
        for x in range(0, padded.shape[1], 8):
            if restart and m and m % restart == 0:
                scan += wr.bytes() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
                wr, last = _Writer(), 0
            q = np.rint(c.T @ padded[y : y + 8, x : x + 8] @ c).astype(int).reshape(-1)[media._ZIGZAG]
            wr.value(lambda s: dc[s], int(q[0]) - last)
            last, run = int(q[0]), 0
            for v in q[1:].tolist():
                if not v:
                    run += 1
                    continue
                while run > 15:
                    wr.bits += code[0xF0]
                    run -= 16
                wr.value(lambda s, r=run: code[r << 4 | s], v)
                run = 0
            if run:
                wr.bits += code[0]
            m += 1
    return out + scan + wr.bytes() + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_frames(restart):
    pixels = np.add.outer(np.arange(20) * 7, np.arange(29) * 3).astype(np.uint8)
    got = media.decode_jpeg(baseline(pixels, restart))
    assert got.shape == pixels.shape and np.abs(got.astype(int) - pixels).max() <= 1


def test_shots_are_found():
    rng = np.random.default_rng(0)
    frames = np.concatenate([rng.integers(a, a + 40, (20, 12, 16)) for a in (0, 120, 60)]).astype(np.uint8)
    assert media.shots(media.histogram_differences(frames)).tolist() == [0, 20, 40]
    data = media.pack_bytes(frames.tobytes())
    assert [r[1:5] for r in media.clip_rows(data)] == [(0, 20, 0.0, 0.8), (20, 40, 0.8, 1.6), (40, 60, 1.6, 2.4)]


def test_clips_of_a_column(spark):
    good = media.pack_bytes(media.padded(b"hello"))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"RIFFxxxxAVI broken")), (4, bytearray(good[: len(good) // 2]))], "id long, data binary")
    out = {r["id"]: r for r in media.clips(df, "id", "data").collect()}
    assert out[1]["clip"] == 0 and out[1]["error"] is None
    assert all(out[i]["clip"] == -1 and out[i]["error"] for i in (2, 3, 4))


def test_text_features(spark):
    texts = edge_texts()
    out = {r["doc_id"]: r for r in media.text_features(frame(spark, rows(texts))).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.pack_bytes(payload)).hexdigest()
    assert out[7]["feature"] == out[8]["feature"]
    stored = media.text_media(frame(spark, rows(texts))).collect()
    assert random.Random(0).choice(stored)["media"][:4] == b"RIFF"
    assert media.text_features(frame(spark, [])).count() == 0
