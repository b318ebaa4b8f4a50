"""Media columns: AVI files of motion-JPEG intra frames.

`encode` stores a payload losslessly in such a file. Its unit is the quantised coefficient of baseline JPEG: a byte b is
the coefficient whose size class is 8 and whose extra bits are b (values -255..-128 and 128..255), with quantisers of 1
and Huffman tables whose only symbol is that class, coded by eight zero bits, so that the bytes stay aligned. Every block
holds 64 bytes and is its own restart interval. `Reader` parses the RIFF chunks and the index of any motion-JPEG AVI,
decodes baseline intra frames (the form above in whole arrays, others symbol by symbol) and yields luma planes; `clips`
cuts at histogram differences that stand out against the differences just before them.

Defined results: null text is an empty payload of one block of zeros; equal texts give equal files and features, repeated
rows a row each. An empty table gives an empty one; texts of any length are stored whole; null ids stay null; other
columns, whatever their names, are ignored. A file without frames has no clips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.shipping import map_arrow

FPS, SIDE, BINS = 25, 8, 16  # frames a second; blocks along a full frame's side; bins of a histogram


def _zigzag() -> np.ndarray:
    """natural[k]: row-major place of the k-th coefficient, along alternating anti-diagonals."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in order])


NATURAL = _zigzag()
_C = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_IDCT = np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64).astype(np.float32)  # coefficients (row-major) to samples


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head(width: int, height: int) -> bytes:
    lengths = bytes([0] * 7 + [1] + [0] * 8)  # one code, of eight bits
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([1] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + lengths + b"\x08")
        + _segment(0xC4, b"\x10" + lengths + b"\x08")
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def padded(data: bytes) -> bytes:
    return data + b"\x00" * (-len(data) % 64 or (64 if not data else 0))


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of 64."""
    blocks = len(payload) // 64
    per = min(blocks, SIDE * SIDE)
    wide, high = (8 * SIDE, 8 * SIDE) if per == SIDE * SIDE else (8 * per, 8)
    frames = -(-blocks // per)
    a = np.zeros((frames * per, 64), np.uint8)
    a[:blocks] = np.frombuffer(payload, np.uint8).reshape(blocks, 64)
    coded = np.zeros((frames, per, 130), np.uint8)
    coded[:, :, 1:128:2] = a.reshape(frames, per, 64)
    coded[:, :, 128] = 0xFF
    coded[:, :, 129] = 0xD0 + np.arange(per) % 8
    coded[:, -1, 129] = 0xD9  # the end of the image
    head = frame_head(wide, high)
    if b"\xff" in payload:
        images = [head + b"".join(bytes(b[:128]).replace(b"\xff", b"\xff\x00") + bytes(b[128:]) for b in f) for f in coded]
    else:
        images = [head + f.tobytes() for f in coded]
    movi, index, at = [b"movi"], [], 4
    for image in images:
        c = _chunk(b"00dc", image)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(c)
    most = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, frames, 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", f"payload_bytes={len(payload)}".encode())
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


class Jpeg:
    """What the segments before a baseline scan say."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant, self.tables, self.restart, at = {}, {}, 0, 2
        while True:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[1 + n :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack(">HHB", body[1:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline frames are intra frames here")
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    n = sum(counts)
                    self.tables[body[0]] = (counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.scan = at
                break
        one = (bytes([0] * 7 + [1] + [0] * 8), b"\x08")
        self.aligned = len(self.parts) == 1 and self.restart == 1 and self.tables.get(0) == one and self.tables.get(0x10) == one
        self.blocks = -(-self.height // 8) * -(-self.width // 8)

    def codes(self, key: int) -> dict[tuple[int, int], int]:
        out, code, k = {}, 0, 0
        counts, symbols = self.tables[key]
        for n, many in enumerate(counts, 1):
            for _ in range(many):
                out[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out


def coefficients(jpeg: Jpeg, data: bytes) -> np.ndarray:
    """Quantised coefficients of the first component's blocks, in zigzag order."""
    scan = data[jpeg.scan :]
    if jpeg.aligned and len(scan) >= jpeg.blocks * 130:
        a = np.frombuffer(scan, np.uint8, jpeg.blocks * 130).reshape(jpeg.blocks, 130)
        if (a[:, 128] == 0xFF).all() and a[-1, 129] == 0xD9 and not a[:, :128:2].any():
            b = a[:, 1:128:2].astype(np.int16)
            return np.where(b < 128, b - 255, b)
    most_h, most_v = max(p[1] for p in jpeg.parts), max(p[2] for p in jpeg.parts)
    across, down = -(-jpeg.width // (8 * most_h)), -(-jpeg.height // (8 * most_v))
    first = jpeg.parts[0]
    out = np.zeros((down * first[2], across * first[1], 64), np.int16)
    dc = {p[0]: jpeg.codes(jpeg.use[p[0]] >> 4) for p in jpeg.parts}
    ac = {p[0]: jpeg.codes(0x10 | (jpeg.use[p[0]] & 15)) for p in jpeg.parts}
    at, bits, held = 0, 0, 0

    def take(n: int) -> int:
        nonlocal at, bits, held
        while held < n:
            byte = scan[at] if at < len(scan) else 0
            if byte == 0xFF:
                if at + 1 < len(scan) and scan[at + 1] != 0:
                    byte, at = 0, at - 1  # a marker: zeros from here on
                else:
                    at += 1
            at += 1
            bits, held = (bits << 8 | byte) & 0xFFFFFFFF, held + 8
        held -= n
        return bits >> held & ((1 << n) - 1)

    def symbol(codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def value(n: int) -> int:
        v = take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    before = dict.fromkeys(dc, 0)
    for mcu in range(across * down):
        if jpeg.restart and mcu and mcu % jpeg.restart == 0:
            held = 0
            while at + 1 < len(scan) and not (scan[at] == 0xFF and 0xD0 <= scan[at + 1] <= 0xD7):
                at += 1
            at += 2
            before = dict.fromkeys(dc, 0)
        for name, h, v, _ in jpeg.parts:
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64, np.int16)
                    before[name] += value(symbol(dc[name]))
                    block[0], k = before[name], 1
                    while k < 64:
                        s = symbol(ac[name])
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        block[k] = value(s & 15)
                        k += 1
                    if name == first[0]:
                        out[mcu // across * v + y, mcu % across * h + x] = block
    return out[: -(-jpeg.height // 8), : -(-jpeg.width // 8)].reshape(-1, 64)


class Reader:
    """Chunks, index and frames of an AVI file."""

    def __init__(self, media: bytes):
        if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.media, self.fps, self.comment, self.frames, movi, index = media, float(FPS), "", [], None, None
        stack = [(12, min(len(media), 8 + struct.unpack("<I", media[4:8])[0]))]
        while stack:
            at, end = stack.pop()
            while at + 8 <= end:
                name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
                if name == b"LIST":
                    if media[at + 8 : at + 12] == b"movi":
                        movi = at + 8
                    else:
                        stack.append((at + 12, at + 8 + size))
                elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                    scale, rate = struct.unpack("<II", media[at + 28 : at + 36])
                    self.fps = rate / max(1, scale)
                elif name == b"ICMT":
                    self.comment = media[at + 8 : at + 8 + size].decode()
                elif name == b"idx1":
                    index = media[at + 8 : at + 8 + size]
                at += 8 + size + size % 2
        if movi is not None and index is not None:
            entries = [struct.unpack("<4sIII", index[i : i + 16]) for i in range(0, len(index), 16)]
            entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
            base = movi if entries and media[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
            self.frames = [(base + at + 8, size) for _, _, at, size in entries]

    def coefficients(self) -> list[tuple[Jpeg, np.ndarray]]:
        out, heads = [], {}
        for at, size in self.frames:
            data = self.media[at : at + size]
            jpeg = next((j for h, j in heads.items() if data.startswith(h)), None)
            if jpeg is None:
                jpeg = Jpeg(data)
                heads[data[: jpeg.scan]] = jpeg
            out.append((jpeg, coefficients(jpeg, data)))
        return out


def luma(jpeg: Jpeg, coefs: np.ndarray) -> np.ndarray:
    """Samples of the blocks (blocks x 64), 0 to 255."""
    natural = np.empty(coefs.shape, np.float32)
    natural[:, NATURAL] = coefs * jpeg.quant[jpeg.parts[0][3]]
    return np.clip(np.rint(natural @ _IDCT) + 128, 0, 255).astype(np.uint8)


def payload_of(coefs: list[np.ndarray], n: int) -> bytes:
    c = np.concatenate(coefs)
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()[:n]


def clips(histograms: np.ndarray, fps: float, memory: int = 8, k: float = 3.0, least: float = 0.05) -> list[tuple[float, float]]:
    """Shots as (from, to) in seconds: a cut where the histogram difference exceeds the mean of the last `memory` differences
    by k deviations and `least`."""
    n = len(histograms)
    share = histograms / np.maximum(1, histograms.sum(1, keepdims=True))
    d = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts, since = [0], 0
    for i in range(len(d)):
        past = d[max(since, i - memory) : i]
        if d[i] > least + (past.mean() + k * past.std() if len(past) else 0):
            cuts.append(i + 1)
            since = i + 1
    return [(a / fps, b / fps) for a, b in zip(cuts, [*cuts[1:], n], strict=True)] if n else []


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's file. The column is stored in the shared folder and is read from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in common.slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).transform(map_arrow, run, "doc_id long, n_bytes long, media binary").transform(common.written, "media", compression="zstd")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<shot:int,start_s:double,end_s:double>>"


def read_media(media: DataFrame) -> DataFrame:
    """Parse and decode the media column: digests of the payload and of the file, a feature and the clips."""
    clip = pa.list_(pa.struct([("shot", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def one(data: bytes) -> tuple:
        reader = Reader(data)
        frames = reader.coefficients()
        n = int(reader.comment.partition("payload_bytes=")[2] or 64 * sum(len(c) for _, c in frames))
        payload = payload_of([c for _, c in frames], n) if frames else b""
        planes = [luma(j, c) for j, c in frames]
        hist = np.array([np.bincount(p.ravel() >> 4, minlength=BINS) for p in planes]).reshape(-1, BINS)
        shots = clips(hist, reader.fps)
        mean = sum(int(p.sum(dtype=np.int64)) for p in planes) / max(1, sum(p.size for p in planes))
        feature = f"frames={len(frames)};shots={len(shots)};seconds={len(frames) / reader.fps:.2f};luma={mean:.3f};hist={'-'.join(map(str, hist.sum(0)))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, [{"shot": i, "start_s": a, "end_s": b} for i, (a, b) in enumerate(shots)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
        for batch in batches:
            rows = [one(m.as_py()) for m in batch.column("media")]
            cols = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").transform(map_arrow, run, _READ)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row per shot: doc_id, shot, start_s, end_s."""
    return read.select("doc_id", F.inline("clips"))


def clip_list(read: DataFrame) -> DataFrame:
    """read_media()'s rows with their clips as text, 'from-to' in seconds, comma-joined."""
    times = F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"]))
    return read.withColumn("clips", F.array_join(times, ","))
