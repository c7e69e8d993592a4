"""Media columns: AVI files with motion-JPEG frames, their frame index, intra decoding and shots.

``read_avi`` walks the RIFF chunks and takes frames from ``idx1`` (or from ``movi`` where there is no
index). ``decode_frames`` decodes each frame on its own, baseline (SOF0) or lossless (SOF3) JPEG, to 8-bit
luma. ``shots`` cuts where the histogram difference of neighbouring frames stands out from its
surroundings, and ``clips`` turns a binary column into timed clip rows.

``pack_bytes`` stores any payload as lossless 8-bit frames. Its Huffman table gives the category s of a
prediction error a code of 9 - s bits, so that code and s extra bits always take 9 bits together: such
frames are ordinary lossless JPEG, yet whole videos are coded and decoded without a loop over symbols.
Frames with any other table go through the general decoder.

Null text counts as empty (one frame of blanks); very long texts are just longer videos; equal texts give
equal files; an empty table gives an empty result. A null or damaged file in ``clips`` gives no clip rows
but one row with clip -1 and the reason.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, whole_text

WIDTH, HEIGHT, FPS = 16, 12, 25
UNIT = WIDTH * HEIGHT

# --- lossless frames with 9 bits for each sample ------------------------------------------------------


def _nine_bit_words() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each error -255..255 (at error + 255), and the error of each word."""
    to, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # ones and a zero: canonical codes of lengths 1 to 9
        to[d + 255] = code << s | (d if d >= 0 else d + (1 << s) - 1)
        back[to[d + 255]] = d
    return to, back


_TO_WORD, _FROM_WORD = _nine_bit_words()
_LENGTHS = bytes([1] * 9 + [0] * 7)
_SYMBOLS = bytes(range(8, -1, -1))


def _head(width: int, height: int) -> bytes:
    """Markers before the scan data of a lossless one-component frame with predictor 1."""
    dht = b"\xff\xc4" + struct.pack(">HB", 3 + 16 + 9, 0) + _LENGTHS + _SYMBOLS
    sof = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
    return b"\xff\xd8" + dht + sof + sos


_HEAD = _head(WIDTH, HEIGHT)


def pack_bytes(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file whose frames hold payload, a positive multiple of WIDTH * HEIGHT bytes."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    n = len(x)
    err = np.empty_like(x)
    err[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    err[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    err[:, 0, 0] = x[:, 0, 0] - 128
    w = _TO_WORD[err.reshape(n, -1, 8) + 255]
    scan = np.empty((n, w.shape[1], 9), np.uint8)
    scan[:, :, 0] = w[:, :, 0] >> 1
    for k in range(1, 8):
        scan[:, :, k] = w[:, :, k - 1] << (8 - k) | w[:, :, k] >> (k + 1)
    scan[:, :, 8] = w[:, :, 7]
    scan = scan.reshape(n, -1)
    stuffed = (scan == 255).sum(1)
    size = len(_HEAD) + scan.shape[1] + stuffed + 2
    odd = size & 1
    row = np.empty((n, 8 + len(_HEAD) + scan.shape[1] + 2), np.uint8)
    row[:, :4] = np.frombuffer(b"00dc", np.uint8)
    row[:, 4:8] = size.astype("<u4").view(np.uint8).reshape(n, 4)
    a = 8 + len(_HEAD)
    row[:, 8:a] = np.frombuffer(_HEAD, np.uint8)
    row[:, a:-2] = scan
    row[:, -2:] = (0xFF, 0xD9)
    width = row.shape[1]
    at = np.flatnonzero(scan.reshape(-1) == 255)
    after = (at // scan.shape[1]) * width + a + at % scan.shape[1] + 1
    pads = (np.flatnonzero(odd) + 1) * width
    where = np.sort(np.concatenate([after, pads]), kind="stable")
    movi = np.insert(row.reshape(-1), where, 0).tobytes()
    total = 8 + size + odd
    index = np.empty((n, 4), "<u4")
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.cumsum(total) - total
    index[:, 3] = size
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, n, 0, 1, int(size.max()), WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, n, int(size.max()), 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4s5I", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body = b"AVI " + hdrl + chunk(b"LIST", b"movi" + movi) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


# --- RIFF ---------------------------------------------------------------------------------------------


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        n = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + n, end)
        at += 8 + n + (n & 1)


def _frames_in(data: bytes, at: int, end: int):
    """Start and size of the video chunks of a movi list, those within rec lists, too."""
    for tag, a, b in _chunks(data, at, end):
        if tag == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _frames_in(data, a + 4, b)
        elif tag[2:] in (b"dc", b"db"):
            yield a, b - a


def read_avi(data: bytes) -> dict:
    """fps, and start and size of each video frame in data: by the index of the first RIFF, else by its chunks; further
    RIFFs (AVIX, in files beyond the index's reach) by their chunks. A size of 0 stands for the frame before."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, found = 25.0, []
    for riff, first, last in _chunks(data, 0, len(data)):
        if riff != b"RIFF" or data[first : first + 4] not in (b"AVI ", b"AVIX"):
            continue
        movi, index = None, None
        for tag, a, b in _chunks(data, first + 4, last):
            kind = data[a : a + 4]
            if tag == b"LIST" and kind == b"hdrl":
                for tag2, a2, b2 in _chunks(data, a + 4, b):
                    if tag2 == b"LIST" and data[a2 : a2 + 4] == b"strl":
                        for tag3, a3, _ in _chunks(data, a2 + 4, b2):
                            if tag3 == b"strh" and data[a3 : a3 + 4] == b"vids":
                                scale, rate = struct.unpack_from("<II", data, a3 + 20)
                                fps = rate / scale if scale and rate else 25.0
            elif tag == b"LIST" and kind == b"movi":
                movi = (a, b)
            elif tag == b"idx1":
                index = np.frombuffer(data, "<u4", (b - a) // 16 * 4, a).reshape(-1, 4).astype(np.int64)
        if movi is None:
            if not first - 8:
                raise ValueError("no movi list")
            continue
        video = [int.from_bytes(b"%02d" % i + k, "little") for i in range(4) for k in (b"dc", b"db")]
        if index is not None and len(index):
            index = index[np.isin(index[:, 0], video)]
            start = index[:, 2] + movi[0] + 8
            # offsets count from the movi tag, or in some files from the file's first byte
            if len(start) and data[start[0] - 8 : start[0] - 6] != struct.pack("<I", index[0, 0])[:2]:
                start = index[:, 2] + 8
            found.append(np.stack([start, index[:, 3]], 1))
        else:
            found.append(np.array(list(_frames_in(data, movi[0] + 4, movi[1])), np.int64).reshape(-1, 2))
    both = np.concatenate(found)
    out = {"fps": fps, "start": both[:, 0], "size": both[:, 1]}
    if len(both) and ((out["start"] + out["size"]) > len(data)).any():
        raise ValueError("the index points beyond the file")
    return out


# --- decoding -----------------------------------------------------------------------------------------


def _decode_packed(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """All frames at once, if each begins with _HEAD; else None."""
    head = np.frombuffer(_HEAD, np.uint8)
    n = len(start)
    if not n or size.min() < len(head) + 2 or (raw[start[:, None] + np.arange(len(head))] != head).any():
        return None
    length = size - len(head) - 2
    begin = start + len(head)
    offset = np.concatenate([[0], np.cumsum(length)])
    scan = raw[np.repeat(begin - offset[:-1], length) + np.arange(offset[-1])]
    keep = np.ones(len(scan), bool)
    keep[1:] = ~((scan[1:] == 0) & (scan[:-1] == 255))
    keep[offset[:-1][length > 0]] = True
    scan = scan[keep]
    if len(scan) != n * UNIT * 9 // 8:
        return None
    b = scan.reshape(n, -1, 9).astype(np.uint16)
    w = np.empty((n, b.shape[1], 8), np.uint16)
    for k in range(8):
        w[:, :, k] = (b[:, :, k] << (k + 1) | b[:, :, k + 1] >> (7 - k)) & 511
    err = _FROM_WORD[w].reshape(n, HEIGHT, WIDTH)
    err[:, 0, 0] += 128
    err[:, :, 0] = np.cumsum(err[:, :, 0], 1)
    return np.cumsum(err, 2, dtype=np.int16).astype(np.uint8)


def _lookup(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16 bits the symbol that they begin with and its length; (0, 0) where none."""
    table, code, k = [(0, 0)] * 65536, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            a = code << (16 - n)
            table[a : a + (1 << (16 - n))] = [(symbols[k], n)] * (1 << (16 - n))
            code, k = code + 1, k + 1
        code <<= 1
    return table


class _Bits:
    """Bits of a scan, from a window of eight bytes that moves along."""

    def __init__(self, scan: bytes):
        self.data, self.at = scan + b"\xff" * 16, 0
        self.bits = 8 * len(scan) + 64

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "big") >> (64 - (self.at & 7) - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.at + n > self.bits:
            raise ValueError("the scan ends early")
        x = self.peek(n)
        self.at += n
        return x

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.at + 16 > self.bits:
            raise ValueError("the scan ends early")
        s, n = table[self.peek(16)]
        if not n:
            raise ValueError("no such Huffman code")
        self.at += n
        return s

    def signed(self, s: int) -> int:
        x = self.take(s)
        return x if not s or x >> (s - 1) else x - (1 << s) + 1


def _zigzag(n: int = 8) -> np.ndarray:
    """Row-major place of each coefficient in scan order, from the rule of alternating diagonals."""
    order = sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * n + c for r, c in order])


_ZIGZAG = _zigzag()
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def decode_jpeg(data: bytes) -> np.ndarray:
    """Luma of one baseline or lossless JPEG frame as (height, width) 8-bit samples."""
    at, quant, huff, restart, frame = 2, {}, {}, 0, None
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while True:
        while at < len(data) and data[at] == 255 and at + 1 < len(data) and data[at + 1] == 255:
            at += 1
        if at + 4 > len(data) or data[at] != 255:
            raise ValueError("a marker is missing")
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                quant[body[0] & 15], body = table, body[65 + 64 * bool(wide) :]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                huff[body[0]], body = _lookup(body[1:17], body[17 : 17 + total]), body[17 + total :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark in (0xC0, 0xC3):
            bits, h, w, count = struct.unpack_from(">BHHB", body)
            frame = (mark, h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)])
            if bits != 8:
                raise ValueError("samples of 8 bits only")
        elif 0xC1 <= mark <= 0xCF:
            raise ValueError(f"JPEG process {mark:#x} isn't an intra frame of motion-JPEG")
        elif mark == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    parts, a, i = [], at, at
    while True:  # split at restart markers, undo byte stuffing
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            parts.append(data[a:])
            break
        if data[i + 1] == 0:
            i += 2
        elif 0xD0 <= data[i + 1] <= 0xD7:
            parts.append(data[a:i])
            a = i = i + 2
        else:
            parts.append(data[a:i])
            break
    parts = [p.replace(b"\xff\x00", b"\xff") for p in parts]
    mark, h, w, comps = frame
    if mark == 0xC3:
        return _lossless(parts, h, w, comps, tables, huff, body[1 + 2 * body[0]], restart)
    return _baseline(parts, h, w, comps, tables, huff, quant, restart)


def _lossless(parts, h, w, comps, tables, huff, predictor, restart) -> np.ndarray:
    if len(comps) != 1:
        raise ValueError("lossless frames have one component here")
    table, bits, out, k = huff[tables[comps[0][0]] >> 4], iter(parts), np.zeros((h, w), np.int64), 0
    b, fresh = _Bits(next(bits)), True
    for y in range(h):
        if restart and k and k % restart == 0:
            b, fresh = _Bits(next(bits)), True
        for x in range(w):
            left, up, corner = (int(out[y, x - 1]) if x else 0), (int(out[y - 1, x]) if y else 0), (int(out[y - 1, x - 1]) if x and y else 0)
            if fresh:
                guess = left if x else 128
            elif not x:
                guess = up
            else:
                guess = (0, left, up, corner, left + up - corner, left + (up - corner >> 1), up + (left - corner >> 1), left + up >> 1)[predictor]
            out[y, x] = (guess + b.signed(b.symbol(table))) & 0xFFFF
            k += 1
        fresh = False
    return (out & 255).astype(np.uint8)


def _baseline(parts, h, w, comps, tables, huff, quant, restart) -> np.ndarray:
    tall, wide = max(c[2] for c in comps), max(c[1] for c in comps)
    if len(comps) == 1:
        tall = wide = 1
        comps = [(comps[0][0], 1, 1, comps[0][3])]
    rows, cols = -(-h // (8 * tall)), -(-w // (8 * wide))
    luma = np.zeros((rows * comps[0][2], cols * comps[0][1], 64), np.int32)
    feed, last = iter(parts), [0] * len(comps)
    b = _Bits(next(feed))
    for m in range(rows * cols):
        if restart and m and m % restart == 0:
            b, last = _Bits(next(feed)), [0] * len(comps)
        for c, (name, ch, cv, _) in enumerate(comps):
            dc, ac = huff[tables[name] >> 4], huff[16 | tables[name] & 15]
            for v in range(cv):
                for u in range(ch):
                    block, k = np.zeros(64, np.int32), 1
                    last[c] += b.signed(b.symbol(dc))
                    block[0] = last[c]
                    while k < 64:
                        s = b.symbol(ac)
                        run, s = s >> 4, s & 15
                        if not s and run < 15:
                            break
                        k += run
                        if k > 63:
                            raise ValueError("too many coefficients")
                        block[k] = b.signed(s)
                        k += 1
                    if not c:
                        luma[m // cols * cv + v, m % cols * ch + u] = block
    full = np.zeros_like(luma)
    full[:, :, _ZIGZAG] = luma * quant[comps[0][3]]
    pixels = np.einsum("xu,rcuv,yv->rxcy", _COS, full.reshape(*full.shape[:2], 8, 8), _COS)
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    return pixels.reshape(pixels.shape[0] * 8, -1)[:h, :w]


def decode_frames(data: bytes, info: dict | None = None) -> np.ndarray:
    """All frames of an AVI file as (n, height, width) 8-bit luma."""
    info = info or read_avi(data)
    start, size = info["start"], info["size"]
    quick = _decode_packed(np.frombuffer(data, np.uint8), start, size)
    if quick is not None:
        return quick
    frames: list[np.ndarray] = []
    for a, n in zip(start.tolist(), size.tolist(), strict=True):
        if n or frames:
            frames.append(decode_jpeg(data[a : a + n]) if n else frames[-1])
    return np.stack(frames) if frames else np.zeros((0, 0, 0), np.uint8)


# --- shots --------------------------------------------------------------------------------------------


def histogram_differences(frames: np.ndarray, bins: int = 16) -> np.ndarray:
    """L1 distance of each frame's luma histogram to the one before; 0 for the first."""
    n = len(frames)
    level = (frames.reshape(n, -1).astype(np.int64) * bins >> 8) + np.arange(n)[:, None] * bins
    hist = np.bincount(level.reshape(-1), minlength=n * bins).reshape(n, bins)
    out = np.zeros(n, np.int64)
    out[1:] = np.abs(hist[1:] - hist[:-1]).sum(1)
    return out


def shots(diff: np.ndarray, around: int = 8, k: int = 3, least: int = 3) -> np.ndarray:
    """First frames of shots: differences over mean + k sigma of the others around, the largest within least frames.

    Whole numbers only, so that equal frames give equal cuts everywhere.
    """
    n = len(diff)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    at = np.arange(n)
    lo, hi = np.maximum(1, at - around), np.minimum(n, at + around + 1)
    s, q = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    count, total, square = hi - lo - 1, s[hi] - s[lo] - diff, q[hi] - q[lo] - diff * diff
    excess = diff * count - total
    high = (excess > 0) & (excess * excess > k * k * (count * square - total * total))
    high[0] = False
    pad = np.concatenate([np.full(least, -1), diff, np.full(least, -1)])
    peak = np.lib.stride_tricks.sliding_window_view(pad, 2 * least + 1)
    high &= (diff >= peak.max(1)) & (peak[:, :least].max(1) < diff)
    return np.concatenate([[0], np.flatnonzero(high)])


def clip_rows(data: bytes) -> list[tuple[int, int, int, float, float, int]]:
    """(clip, first frame, end frame, start second, end second, difference at its cut)."""
    info = read_avi(data)
    frames = decode_frames(data, info)
    diff = histogram_differences(frames) if len(frames) else np.zeros(0, np.int64)
    first = shots(diff).tolist()
    ends = [*first[1:], len(frames)]
    return [(i, a, b, a / info["fps"], b / info["fps"], int(diff[a])) for i, (a, b) in enumerate(zip(first, ends, strict=True))]


CLIP_SCHEMA = "clip int, first_frame long, end_frame long, start_s double, end_s double, cut_score long, error string"


def clips(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per detected shot of each AVI file in column media, with key."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            keys, rows = [], []
            for k, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                try:
                    if not data.is_valid:
                        raise ValueError("no media")
                    found = [(*r, None) for r in clip_rows(data.as_py())]
                except (ValueError, IndexError, KeyError, StopIteration, struct.error) as e:
                    found = [(-1, None, None, None, None, None, str(e) or type(e).__name__)]
                keys += [k] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *(x.split()[0] for x in CLIP_SCHEMA.split(", "))])

    return bounded_batches(df).select(key, media).mapInArrow(run, f"`{key}` {kind}, {CLIP_SCHEMA}")


# --- texts as media -----------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """text and blanks up to a positive multiple of the frame size."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each whole text as an AVI file."""

    def run(parts):
        for part in parts:
            media = [pack_bytes(padded(t.as_buffer().to_pybytes())) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return bounded_batches(docs).select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def text_features(docs: DataFrame) -> DataFrame:
    """Store each text as media, read the stored bytes back and digest them, their frames and their shots."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "n_clips", "feature"]

    def run(parts):
        for part in parts:
            rows = []
            for t in part.column(1):
                text = t.as_buffer().to_pybytes()
                media = pack_bytes(padded(text))
                info = read_avi(media)
                frames = decode_frames(media, info)
                payload = frames.tobytes()
                diff = histogram_differences(frames)
                cuts = shots(diff)
                ends = np.append(cuts[1:], len(frames))
                clip = ",".join(f"{a * 1000 // int(info['fps'])}-{b * 1000 // int(info['fps'])}" for a, b in zip(cuts.tolist(), ends.tolist(), strict=True))
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(frames), len(cuts), f"clips_ms={clip};motion={int(diff.sum())};peak={int(diff.max())}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_clips long, feature string")
