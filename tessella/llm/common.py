"""What the operators of this subpackage share: reading tables, writing intermediate tables to the shared
folder, folds by checksum and vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.scratch import cut, scratch
from tessella.shipping import release_driver


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shared_path = scratch


def written(df: DataFrame, tag: str = "step", **options: str) -> DataFrame:
    """Written and read back (`cut`). A query writes some dozens of tables, and what planning and compiling each of them left
    behind in the driver is given back after it."""
    out = cut(df, tag, **options)
    release_driver(df.sparkSession)
    return out


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def thin(df: DataFrame, key: Column, counts: dict, target: int, group: Column) -> DataFrame:
    """About `target` rows of each group, chosen by a hash of the key; a group with fewer rows keeps all of them."""
    scale = 1 << 30
    cut = F.lit(0).cast("long")
    for g, n in counts.items():
        cut = F.when(group == F.lit(g), F.lit(min(scale, int(scale * target / max(1, n))))).otherwise(cut)
    return df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(scale)) < cut)


_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 0 for c in range(256)
)
_POW_LEN = 1 << 12
_BASE = 0x9E3779B97F4A7C15


def _powers() -> np.ndarray:
    out, x = np.empty(_POW_LEN, np.uint64), 1
    for i in range(_POW_LEN):
        out[i] = x
        x = x * _BASE & 0xFFFFFFFFFFFFFFFF
    return out


_POW = _powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the offsets at which each text's words begin (one more than texts).

    Words are runs of ASCII letters and digits and of bytes from 0x80 on; A-Z are lower-cased."""
    buf = b"\n".join(texts).translate(_FOLD)
    a = np.frombuffer(buf, np.uint8)
    is_word = a != 0
    edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False)) if len(a) else np.zeros(0, np.int64)
    starts, ends = edge[0::2], edge[1::2]
    if len(starts):
        lens = ends - starts
        offs = np.cumsum(lens) - lens
        rel = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(offs, lens)
        long_word = int(lens.max()) >= _POW_LEN
        h = (a[is_word].astype(np.uint64) + np.uint64(1)) * _POW[rel & (_POW_LEN - 1)]
        if long_word:
            h = h + mix((rel >> 12).astype(np.uint64)) * (rel >= _POW_LEN)
        h = mix(np.add.reduceat(h, offs) + lens.astype(np.uint64))
    else:
        h = np.zeros(0, np.uint64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)]) if len(texts) else np.zeros(1, np.int64)
    return h, np.searchsorted(starts, begins)


def chains(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows (from, to, UTF-8 texts) of a batch, of about most_bytes each; null counts as empty."""
    texts: list[bytes] = []
    size = begin = 0
    for i, t in enumerate(batch.column(column)):
        v = t.as_buffer().to_pybytes() if t.is_valid else b""
        if texts and size + len(v) > most_bytes:
            yield begin, i, texts
            texts, size, begin = [], 0, i
        texts.append(v)
        size += len(v)
    if texts:
        yield begin, begin + len(texts), texts


def fresh(*names: str) -> list[str]:
    """Names for helper columns that no table has."""
    tag = uuid.uuid4().hex[:12]
    return [f"_{n}_{tag}" for n in names]


SIEVE_BITS = 24


def sieve(df: DataFrame, key: Column, members: DataFrame) -> tuple[DataFrame, str]:
    """df with a boolean column, and its name: false only where the key is surely not in the first column of members.

    A bitmap of 2^SIEVE_BITS hashed bits, as a broadcast table of at most 2^(SIEVE_BITS - 6) words whatever the input, lets
    wide rows that can't match stay where they are instead of being shuffled for a join."""
    word, bit, bits, maybe = fresh("word", "bit", "bits", "maybe")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE_BITS))
    at = place(F.col(members.columns[0]))
    words = members.select(F.shiftright(at, 6).alias(word), (at % 64).cast("int").alias(bit))
    words = words.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias(bits))
    here = place(key.cast(members.schema[0].dataType))
    marked = df.withColumns({word: F.shiftright(here, 6), bit: (here % 64).cast("int")}).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned({bits}, {bit}) & 1L = 1L"), F.lit(False))
    return marked.withColumn(maybe, hit).drop(word, bit, bits), maybe


def _near(df: DataFrame, keys: Sequence[Column], others: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """df's rows that can't meet others, those that may, others under fresh names, and the condition of meeting."""
    others = others.toDF(*fresh(*others.columns))
    marked, maybe = sieve(df, keys[0], others)
    same = reduce(Column.__and__, (k.eqNullSafe(F.col(c)) for k, c in zip(keys, others.columns, strict=True)))
    return marked.where(~F.col(maybe)).drop(maybe), marked.where(maybe).drop(maybe), others, same


def without(df: DataFrame, keys: Sequence[Column], gone: DataFrame) -> DataFrame:
    """df's rows whose keys equal no row of gone (null equals null). Only rows that the sieve lets through are shuffled."""
    far, near, gone, same = _near(df, keys, gone)
    return far.unionByName(near.join(gone, same, "left_anti"))


def once(df: DataFrame, keys: Sequence[Column], repeated: DataFrame) -> DataFrame:
    """df with one row (the first by its JSON) of those whose keys equal a row of repeated; other rows as they are."""
    far, near, repeated, same = _near(df, keys, repeated)
    box, *own = fresh("box", *repeated.columns)
    boxed = near.join(repeated, same, "left_semi").select(F.struct(*df.columns).alias(box), *(k.alias(c) for k, c in zip(keys, own, strict=True)))
    one = boxed.groupBy(*own).agg(F.min_by(box, F.to_json(box)).alias(box)).select(f"{box}.*")
    return far.unionByName(near.join(repeated, same, "left_anti")).unionByName(one)


HOT_LEAST, HOT_MOST = 64, 4096


def lookup(rows: DataFrame, keys: list[str], entries: DataFrame, size: str, total: int, number: int | None = None) -> DataFrame:
    """rows with the columns of entries (one row for a value of the keys), null where there is none.

    size names the column of entries that says how many of the `total` rows meet the entry. Fewer than HOT_MOST entries can
    be met by more than total / HOT_MOST rows each, so those are broadcast whatever the input; the rest is joined by a shuffle
    in which no key has more rows than that. Where it is known that there are no more than HOT_MOST entries (number), all are
    broadcast, and nothing is shuffled."""
    if number is not None and number <= HOT_MOST:
        return rows.join(F.broadcast(entries), keys, "left")
    cut_at = max(HOT_LEAST, total // HOT_MOST)
    [hot] = fresh("hot")
    seen = rows.join(F.broadcast(entries.where(F.col(size) > cut_at).withColumn(hot, F.lit(True))), keys, "left")
    far = seen.where(F.col(hot).isNull()).select(*rows.columns).join(entries.where(F.col(size) <= cut_at), keys, "left")
    return seen.where(hot).drop(hot).unionByName(far)
