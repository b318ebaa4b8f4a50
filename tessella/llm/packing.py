"""Packing token pieces into fixed-length sequences by cutting-stock column generation.

A document is cut into full pieces of SEQ tokens and one shorter rest. The rests' lengths, rounded up to classes of
GRAIN tokens, form a histogram (bounded: classes x salts) whose cutting-stock linear program is solved on the driver:
a revised simplex over patterns, new patterns priced by a knapsack dynamic program over the duals. Pattern counts are
rounded down and what remains is filled greedily, largest class first. Documents are ranked within their class (over
salts, as many as the class needs for at most about `PER_SALT` rows in a task) and the rank decides the pattern, its
instance and so the sequence. A full piece fills a sequence of its own and isn't ranked.

Defined results: null counts as empty, an empty text is the one token of its end mark; repeated rows, and rows with null
or equal ids, are packed each. Pieces that tie in length are ranked by doc_id, start and checksum; which of two equal ones
comes first makes no difference. Texts of any length are read whole. An empty table gives an empty one; other columns,
whatever their names, are ignored. The string of an added token (`<|endoftext|>`) stands for that token, as the library
reads it; `added=False` reads it as ordinary text.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.shipping import map_arrow

SEQ, END, GRAIN, PER_SALT = 2048, 1, 8, 100_000
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """The byte-level BPE of the vocabulary's JSON file. The faster of the two libraries that read the vocabulary encodes what
    stands between the file's added tokens, which are cut out first, as the library of the file does."""

    def __init__(self, vocabulary: str, added: bool):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            listed = json.load(f)["added_tokens"] if added else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in listed):
            raise ValueError("added tokens of this vocabulary take more than their own characters")
        self.added = {t["content"]: t["id"] for t in listed}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bpe = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(t in text for t in self.added):
            return self.bpe.encode_ordinary(text)
        return [i for part in self.cut.split(text) for i in ([self.added[part]] if part in self.added else self.bpe.encode_ordinary(part))]


@lru_cache(maxsize=4)
def encoder(vocabulary: str, added: bool = True) -> Encoder:
    return Encoder(vocabulary, added)


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, seq: int = SEQ, end: int = END, added: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of every row's token ids with the end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, added)
        for batch in batches:
            for a, _, texts in common.slices(batch, "text"):
                ids, rows = batch.column("doc_id"), []
                for i, t in enumerate(texts):
                    tokens = np.array([*enc.encode(t.decode()), end], "<u4")
                    rows += [(a + i, s, min(seq, len(tokens) - s), zlib.crc32(tokens[s : s + seq].tobytes()), len(tokens)) for s in range(0, len(tokens), seq)]
                got = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(got[:, 0])), *(pa.array(got[:, j]) for j in range(1, 5))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern. duals[c] is the value of an item of size c + 1."""
    items = np.flatnonzero(duals > 1e-12)
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = items[: np.searchsorted(items, room)]
        best[room] = best[room - 1]
        if len(fit):
            v = best[room - 1 - fit] + duals[fit]
            j = int(v.argmax())
            if v[j] > best[room] + 1e-15:
                best[room], pick[room] = v[j], fit[j]
    pattern, room = np.zeros(len(duals), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            pattern[pick[room]] += 1
            room -= pick[room] + 1
    return best[capacity], pattern


def column_generation(demand: np.ndarray, capacity: int, most_rounds: int = 4000, gap: float = 2e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every class's demand is met. demand[c]: items of size c + 1."""
    live = np.flatnonzero(demand > 0)
    if not len(live):
        return []
    m = len(live)
    columns = np.zeros((m, m))
    columns[np.arange(m), np.arange(m)] = capacity // (live + 1)
    cost = np.ones(m)
    inverse = np.diag(1 / columns.diagonal())
    x = inverse @ demand[live]
    bound = 0.0
    for _ in range(most_rounds):
        y = cost @ inverse
        if y.min() < -1e-9:  # a surplus column
            j = int(y.argmin())
            enter, c = np.zeros(m), 0.0
            enter[j] = -1
        else:
            full = np.zeros(len(demand))
            full[live] = y
            value, pattern = price(full, capacity)
            bound = max(bound, x @ cost / value) if value > 0 else bound
            if value <= 1 + 1e-7 or x @ cost <= bound * (1 + gap):
                break
            enter, c = pattern[live].astype(float), 1.0
        u = inverse @ enter
        can = np.flatnonzero(u > 1e-9)
        out = can[np.argmin(x[can] / u[can])]
        step = x[out] / u[out]
        x -= step * u
        x[out] = step
        columns[:, out], cost[out] = enter, c
        inverse[out] /= u[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(u[others], inverse[out])
    plan, left = [], demand.astype(np.int64).copy()
    for j in np.flatnonzero(cost > 0):
        n = int(np.floor(x[j] + 1e-9))
        if n:
            pattern = np.zeros(len(demand), np.int64)
            pattern[live] = np.round(columns[:, j]).astype(np.int64)
            plan.append((pattern, n))
            left -= pattern * n
    left = np.maximum(left, 0)
    while left.any():
        pattern, room = np.zeros(len(demand), np.int64), capacity
        for c in np.flatnonzero(left)[::-1]:
            k = min(left[c], room // (c + 1))
            pattern[c] += k
            room -= k * (c + 1)
        used = pattern > 0
        n = max(1, int((left[used] // pattern[used]).min()))
        plan.append((pattern, n))
        left -= pattern * n
    return plan


class Slots:
    """Where rank r of class c goes: a sorted list of rank ranges per class, each with the pattern's first sequence."""

    def __init__(self, demand: np.ndarray, capacity: int):
        self.by_class: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        base, ranges = 0, {}
        for pattern, n in column_generation(demand, capacity):
            for c in np.flatnonzero(pattern):
                ranges.setdefault(int(c), []).append((int(pattern[c]) * n, int(pattern[c]), base))
            base += n
        self.sequences = base
        for c, got in ranges.items():
            size, per, first = (np.array(v, np.int64) for v in zip(*got, strict=True))
            self.by_class[c] = (np.cumsum(size) - size, per, first)

    def find(self, c: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(c), np.int64)
        for k in np.unique(c):
            here = c == k
            start, per, first = self.by_class[int(k)]
            j = np.searchsorted(start, rank[here], "right") - 1
            out[here] = first[j] + (rank[here] - start[j]) // per[j]
        return out


def pack(pieces: DataFrame, seq: int = SEQ, grain: int = GRAIN, per_salt: int = PER_SALT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, ...) of at most seq tokens. pieces is read
    several times, so it should be a written table."""
    capacity = seq // grain
    klass, salt, rank = common.fresh("class", "salt", "rank")
    rest = pieces.where(F.col("length") < seq).withColumn(klass, (F.floor((F.col("length") + grain - 1) / grain) - 1).cast("int"))
    demand = np.zeros(capacity, np.int64)
    for r in rest.groupBy(klass).count().collect():
        demand[r[klass]] = r["count"]
    slots = Slots(demand, capacity)
    salts = np.maximum(1, -(-demand // per_salt))
    many = F.element_at(F.array(*(F.lit(int(n)) for n in salts)), F.col(klass) + 1)
    # of the row alone, where in its file it stands included, so that repeated rows spread too
    place = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    rest = common.written(rest.withColumn(salt, F.pmod(place, many).cast("int")), "packing-rests")
    begin = np.cumsum(salts) - salts
    counts = np.zeros(int(salts.sum()), np.int64)
    for r in rest.groupBy(klass, salt).count().collect():
        counts[begin[r[klass]] + r[salt]] = r["count"]
    before = np.cumsum(counts) - counts
    first = before - np.repeat(before[begin], salts)  # rows of the class with a smaller salt
    names = pieces.columns
    by = Window.partitionBy(klass, salt).orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    ranked = rest.withColumn(rank, F.row_number().over(by).cast("long"))

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, s, r = (b.column(n).to_numpy() for n in (klass, salt, rank))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(slots.find(c, first[begin[c] + s] + r - 1))], [*names, "sequence_id"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long"
    placed = ranked.transform(map_arrow, place_all, schema)
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))
    full = pieces.where(F.col("length") >= seq)
    return placed.unionByName(full.withColumn("sequence_id", F.lit(slots.sequences) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Tokenise and pack: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(common.written(token_pieces(docs), "pieces"))
