"""Sources of frames: generated test frames and images from directories; keys frame_id, px, py with r, g, b, depth."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.mathx import clamp, idiv, trunc
from tessella.functions.rng import uniform
from tessella.shipping import map_arrow


def _grid(spark: SparkSession, width: int, height: int, frames: int = 1) -> DataFrame:
    i, n = F.col("id"), width * height
    return spark.range(frames * n).select(F.floor(i / n).alias("frame_id"), (i % width).cast("int").alias("px"), (F.floor(i / width) % height).cast("int").alias("py"))


def byte(c: Column) -> Column:
    return clamp(c, 0, 255).cast("int")


def noisy(c: int, amount: int, seed: int, *key: Column | str) -> Column:
    """A colour with whole-numbered noise of up to amount either way."""
    if amount == 0:
        return byte(F.lit(c))
    return byte(F.lit(c) + F.floor(uniform(seed, *key) * (2 * amount + 1)) - amount)


def _wave(width: int, height: int, amount: int) -> Column:
    return trunc(amount * F.sin(30.0 * F.col("py") / height) * F.sin(30.0 * F.col("px") / width))


def _colored(rows: DataFrame, rgb, depth: Column, noise: int, seed: int) -> DataFrame:
    at = [F.col(c) for c in ("frame_id", "px", "py")]
    colors = [c if noise == 0 else byte(c + F.floor(uniform(seed, n, *at) * (2 * noise + 1)) - noise) for n, c in zip("rgb", rgb, strict=True)]
    return rows.select("frame_id", "px", "py", *(c.cast("int").alias(n) for n, c in zip("rgb", colors, strict=True)), depth.cast("int").alias("depth"))


def uniform_frame(spark: SparkSession, width: int = 640, height: int = 480, noise: bool = False, seed: int = 42) -> DataFrame:
    depth = F.lit(1200) + (_wave(width, height, 50) if noise else F.lit(0))
    return _colored(_grid(spark, width, height), [F.lit(32), F.lit(128), F.lit(128)], depth, 15 if noise else 0, seed)


def paraboloid_frame(spark: SparkSession, width: int = 640, height: int = 480) -> DataFrame:
    dx, dy = F.col("px") - width // 2, F.col("py") - height // 2
    return _colored(_grid(spark, width, height), [F.lit(0), F.lit(128), F.lit(128)], 600 + idiv(dx * dx + dy * dy, 80), 0, 0)


def sphere_frames(spark: SparkSession, frames: int, width: int = 640, height: int = 480, noise: bool = False, seed: int = 42) -> DataFrame:
    """A near red disc going round on a far ground, one turn in a hundred frames."""
    rows = _grid(spark, width, height, frames)
    phi = 2.0 * 3.1415 * F.col("frame_id") / 100.0
    dx = F.col("px") - trunc(width // 2 + 70.0 * F.cos(phi))
    dy = F.col("py") - trunc(height // 2 + 70.0 * F.sin(phi))
    near = F.floor(F.sqrt(dx * dx + dy * dy)) < 80
    pick = lambda a, b: F.when(near, a).otherwise(b)
    depth = pick(800, 1200) + (_wave(width, height, 50) if noise else F.lit(0))
    return _colored(rows, [pick(192, 32), pick(32, 128), pick(32, 128)], depth, 15 if noise else 0, seed)


def grab(frames: DataFrame, first: int = 0, last: int | None = None, skip: int = 1) -> DataFrame:
    """A range of frames, every skip-th of them."""
    out = frames.where((F.col("frame_id") >= first) & (F.col("frame_id") % skip == 0))
    return out if last is None else out.where(F.col("frame_id") <= last)


# -- images -------------------------------------------------------------------------------------------------------------
def read_pnm(data: bytes) -> np.ndarray:
    """Binary PGM or PPM, of 8 or 16 bits: height x width x channels."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, (w, h, top) = fields[0], map(int, fields[1:])
    if kind not in (b"P5", b"P6"):
        raise ValueError(f"no binary PGM or PPM: {kind!r}")
    n = 3 if kind == b"P6" else 1
    return np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * n, at + 1).reshape(h, w, n).astype(np.int32)


def write_pnm(pixels: np.ndarray, top: int = 255) -> bytes:
    h, w, n = pixels.shape
    return f"{'P6' if n == 3 else 'P5'}\n{w} {h}\n{top}\n".encode() + pixels.astype(">u2" if top > 255 else np.uint8).tobytes()


def read_png(data: bytes) -> np.ndarray:
    """8- or 16-bit grey, RGB or with alpha, not interlaced: height x width x channels without alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed = 8, b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth not in (8, 16) or kind not in (0, 2, 4, 6) or laced:
                raise ValueError("this kind of PNG is not read")
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    n = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    step, raw = n * depth // 8, zlib.decompress(packed)
    line = w * step
    out, above = np.zeros((h, line), np.uint8), np.zeros(line, np.int32)
    for y in range(h):
        how, row = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1).astype(np.int32)
        if how == 2:
            row = (row + above) & 255
        elif how == 1:
            row = row.reshape(w, step).cumsum(0).ravel() & 255
        elif how in (3, 4):
            for x in range(line):
                left = row[x - step] if x >= step else 0
                if how == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    p = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v: abs(p - v))
                row[x] = (row[x] + guess) & 255
        out[y], above = row, row
    pixels = out.reshape(h, w, n, depth // 8)
    pixels = pixels[..., 0].astype(np.int32) if depth == 8 else pixels[..., 0].astype(np.int32) * 256 + pixels[..., 1]
    return pixels[..., :1] if kind in (0, 4) else pixels[..., :3]


def write_png(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    raw = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in pixels)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_image(data: bytes) -> np.ndarray:
    return read_png(data) if data[:4] == b"\x89PNG" else read_pnm(data)


def decode_frames(pairs: DataFrame) -> DataFrame:
    """pairs: frame_id, color (bytes or null), depth (bytes or null). One row per pixel; a missing image counts as zeros, and
    of images of different size the common part is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                images = [None if (b := batch.column(c)[i].as_py()) is None else decode_image(b) for c in ("color", "depth")]
                sizes = [m.shape[:2] for m in images if m is not None]
                if not sizes:
                    continue
                h, w = min(s[0] for s in sizes), min(s[1] for s in sizes)
                color = np.zeros((h, w, 3), np.int32) if images[0] is None else np.broadcast_to(images[0][:h, :w], (h, w, 3))
                depth = np.zeros((h, w), np.int32) if images[1] is None else images[1][:h, :w, 0]
                y, x = np.mgrid[0:h, 0:w]
                ids = np.full(h * w, batch.column("frame_id")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.ravel().astype(np.int32)), pa.array(y.ravel().astype(np.int32)), *(pa.array(color[..., k].ravel().astype(np.int32)) for k in range(3)), pa.array(depth.ravel().astype(np.int32))], ["frame_id", "px", "py", "r", "g", "b", "depth"])

    return pairs.select(F.col("frame_id").cast("long").alias("frame_id"), "color", "depth").transform(map_arrow, run, "frame_id long, px int, py int, r int, g int, b int, depth int")


def _numbered(files: DataFrame) -> DataFrame:
    """Place in the order of names. Names alone are ranked; contents stay out of the sort."""
    names = files.select("path").withColumn("frame_id", F.row_number().over(Window.orderBy("path")) - 1)
    return files.join(names, "path")


def read_static(spark: SparkSession, prefix: str) -> DataFrame:
    """One frame from prefix_color.png and prefix_depth.pgm."""
    color = spark.read.format("binaryFile").load(f"{prefix}_color.png").select(F.lit(0).alias("frame_id"), F.col("content").alias("color"))
    depth = spark.read.format("binaryFile").load(f"{prefix}_depth.pgm").select(F.lit(0).alias("frame_id"), F.col("content").alias("depth"))
    return decode_frames(color.join(depth, "frame_id"))


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """PGM files are depths, PPM and PNG files colours; both are ordered by name and paired by place. There are as many frames
    as depths."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    depth = _numbered(files.where(F.lower("path").endswith(".pgm"))).select("frame_id", F.col("content").alias("depth"))
    color = _numbered(files.where(F.lower("path").rlike(r"\.(ppm|png)$"))).select("frame_id", F.col("content").alias("color"))
    return decode_frames(depth.join(color, "frame_id", "left"))


def record_pairs(index: DataFrame) -> DataFrame:
    """index: place, name. Each depth entry (d...) with the next colour entry (r...) after it; the first pair is frame 0."""
    after = Window.orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    color = F.first(F.when(F.col("name").startswith("r"), F.col("name")), ignorenulls=True).over(after)
    pairs = index.withColumn("color", color).where(F.col("name").startswith("d") & F.col("color").isNotNull())
    return pairs.select((F.row_number().over(Window.orderBy("place")) - 1).alias("frame_id"), F.col("name").alias("depth"), "color")


def read_record(spark: SparkSession, folder: str) -> DataFrame:
    """A recorded stream: INDEX.txt lists depth and colour files of this folder in order of time."""
    lines = spark.read.text(f"{folder}/INDEX.txt", wholetext=True).select(F.posexplode(F.split("value", r"\s+")).alias("place", "name")).where("name != ''")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    pairs = record_pairs(lines)
    depth = pairs.join(files.withColumnsRenamed({"file": "depth", "content": "_d"}), "depth")
    both = depth.join(files.withColumnsRenamed({"file": "color", "content": "_c"}), "color")
    return decode_frames(both.select("frame_id", F.col("_c").alias("color"), F.col("_d").alias("depth")))


def open_frames(spark: SparkSession, mode: str, arg: str = "") -> DataFrame:
    """Sources by name: test (uniform, paraboloid or sphere), static, images, freenect."""
    if mode == "test":
        return {"uniform": uniform_frame, "paraboloid": paraboloid_frame, "sphere": lambda s: sphere_frames(s, 100)}[arg or "uniform"](spark)
    readers = {"static": read_static, "images": read_directory, "freenect": read_record}
    if mode not in readers:
        raise ValueError(f"no source named {mode}")
    return readers[mode](spark, arg)
