"""SentencePiece encoding and decoding; texts above CHUNK characters by a parallel scan.

The model is a byte-fallback BPE, whose encoding of a string is the one sequence of pieces in which all neighbours are
compatible (the two strings joined encode to just these two pieces). So encoding is a search over a lattice whose
states are (end of the last piece, last piece) and whose steps weigh 0 if allowed and minus infinity if not. A giant
text is cut into chunks. A chunk knows the pieces that may reach over its start and end from a few characters beside it,
and gives the max-plus transfer matrix between these boundary states. Matrices combine associatively (a tree of
products per text), which fixes the states at all cuts, and every chunk then backtraces its own pieces. Pieces never
reach over the start of a run of word marks, so a chunk with such a place needs the lattice at its two ends alone and
has the library encode what lies between; a chunk without any (text without spaces) goes through the lattice whole.

Defined results: null and empty texts have no tokens and decode to the empty text; each repeated row is encoded, whatever
its id, null too. Where several paths were equally good, the largest state would be taken, but compatible neighbours leave
one. An empty table gives an empty one; texts are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.shipping import map_arrow

MODEL, CHUNK, MARK = "piece_bpe_32k.model", 16384, "▁"
PRIME = (1 << 31) - 1
State = tuple[int, str]  # characters over the cut, last piece; ("", at 0) where no piece can reach over
Matrix = dict[State, dict[State, float]]


class Bpe:
    """The model's pieces, its compatibility of neighbours and the lattice over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) for i in range(n)]
        self.pieces = {self.sp.id_to_piece(i): (i, self.sp.get_score(i)) for i in range(n) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces of this model reach over word marks")
        self.longest = max(map(len, self.pieces))
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ask: dict[tuple[str, str], bool] = {}
        self.lead = self.sp.piece_to_id(f"{MARK}a")

    def merged(self, s: str) -> list[str]:
        """BPE of a short string: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = self.pieces.get(parts[i] + parts[i + 1])
                if got and (best is None or got[1] > best):
                    best, at = got[1], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self.ask:
            if len(self.ask) > 1 << 20:
                self.ask.clear()
            self.ask[key] = self.merged(left + right) == [left, right]
        return self.ask[key]

    def is_piece(self, s: str) -> bool:
        return len(s) == 1 or s in self.pieces

    def ids(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        return [got[0]] if got else [self.bytes[b] for b in piece.encode()]

    def forward(self, s: str, start: int, last: str, stop: int) -> dict[int, tuple[str, int]]:
        """Ends of valid paths from (start, last), with last piece and its start; only pieces that start before stop."""
        found = {start: (last, -1)}
        for p in range(start, min(stop, len(s))):
            if p not in found:
                continue
            before = found[p][0]
            for q in range(p + 1, min(len(s), p + self.longest) + 1):
                piece = s[p:q]
                if q not in found and self.is_piece(piece) and (not before or self.compatible(before, piece)):
                    found[q] = (piece, p)
        return found

    def back(self, found: dict[int, tuple[str, int]], start: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > start:
            piece, end = found[end]
            out.append(self.ids(piece))
        return [i for x in reversed(out) for i in x]

    def encode_marked(self, s: str) -> list[int]:
        """Ids of a string that begins with a word mark, by the library (which puts that mark there itself)."""
        if s in ("", MARK):
            return self.ids(s) if s else []
        return self.sp.encode(s[1:].replace(MARK, " "))


_loaded: dict[str, Bpe] = {}


def bpe(model: str) -> Bpe:
    import public_tokenizers

    if model not in _loaded:
        _loaded[model] = Bpe(public_tokenizers.path(model))
    return _loaded[model]


class Chunk:
    """The characters [a, b) of a window, which also holds some on either side."""

    def __init__(self, m: Bpe, left: str, core: str, right: str):
        self.m, self.w, self.a, self.b = m, left + core + right, len(left), len(left) + len(core)
        self.end = not right
        free = [p for p in (self._next_free(self.a), self._last_free()) if p is not None]
        self.first, self.last = (free[0], free[-1]) if free else (None, None)

    def free(self, p: int) -> bool:
        return p == 0 or (p < len(self.w) and self.w[p] == MARK and self.w[p - 1] != MARK)

    def _next_free(self, p: int) -> int | None:
        return next((q for q in range(p, self.b) if self.free(q)), None)

    def _last_free(self) -> int | None:
        return next((q for q in range(self.b - 1, self.a - 1, -1) if self.free(q)), None)

    def entries(self) -> list[State]:
        if self.free(self.a):
            return [(0, "")]
        out = []
        for over in range(min(self.m.longest, len(self.w) - self.a + 1)):
            for n in range(over + 1, self.m.longest + 1):
                piece = self.w[max(0, self.a + over - n) : self.a + over]
                if len(piece) == n and self.m.is_piece(piece):
                    out.append((over, piece))
        return out

    def exits(self, found: dict[int, tuple[str, int]]) -> dict[State, int]:
        if self.end:
            return {(0, ""): self.b} if self.b in found else {}
        return {((0, "") if p == self.b and self.free(p) else (p - self.b, found[p][0])): p for p in found if p >= self.b}

    def matrix(self) -> Matrix:
        out: Matrix = {}
        tail = self.exits(self.m.forward(self.w, self.last, "", self.b)) if self.last is not None else None
        for over, piece in self.entries():
            if tail is None:
                got = self.exits(self.m.forward(self.w, self.a + over, piece, self.b))
            else:
                got = tail if self.first in self.m.forward(self.w, self.a + over, piece, self.first) else {}
            if got:
                out[over, piece] = dict.fromkeys(got, 0.0)
        return out

    def trace(self, entry: State, leave: State) -> list[int]:
        over, piece = entry
        if self.first is None:
            found = self.m.forward(self.w, self.a + over, piece, self.b)
            return self.m.back(found, self.a + over, self.exits(found)[leave])
        head = self.m.back(self.m.forward(self.w, self.a + over, piece, self.first), self.a + over, self.first)
        found = self.m.forward(self.w, self.last, "", self.b)
        return head + self.m.encode_marked(self.w[self.first : self.last]) + self.m.back(found, self.last, self.exits(found)[leave])


def product(x: Matrix, y: Matrix) -> Matrix:
    """Max-plus product; what is missing weighs minus infinity."""
    out: Matrix = {}
    for i, row in x.items():
        got: dict[State, float] = {}
        for k, v in row.items():
            for j, u in y.get(k, {}).items():
                got[j] = max(got.get(j, -np.inf), v + u)
        if got:
            out[i] = got
    return out


def scan(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """The entry and exit state of every chunk on the best path, by a tree of associative products."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([product(low[i], low[i + 1]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    states: list[tuple[State, State]] = [((0, ""), (0, ""))]
    for low in reversed(levels[:-1]):
        finer = []
        for i, (entry, leave) in enumerate(states):
            if 2 * i + 1 == len(low):
                finer.append((entry, leave))
                continue
            x, y = low[2 * i], low[2 * i + 1]
            mid = max((k for k in x[entry] if leave in y.get(k, {})), key=lambda k: (x[entry][k] + y[k][leave], k))
            finer += [(entry, mid), (mid, leave)]
        states = finer
    return states


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows each, which bound what a worker holds as Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


_IDS = "doc_id long, row long, chunk int, chunks int, ids array<int>"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    """rows: doc_id, row, chunk, chunks, ids. The ids go through one flat array, not through nested Python lists."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    *head, ids = list(zip(*rows, strict=True)) or [()] * 5
    parts = [np.array(x, np.int32) for x in ids]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(head, types, strict=True)), lists], ["doc_id", "row", "chunk", "chunks", "ids"])


def _small(docs: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe(model)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, _, texts in common.slices(batch, "text", 1 << 19):
                got = m.sp.encode([t.decode() for t in texts], num_threads=1) if texts else []
                yield _out([(ids[a + i], 0, 0, 1, x) for i, x in enumerate(got)])

    return docs.transform(map_arrow, run, _IDS)


def _cut(docs: DataFrame, model: str, size: int) -> DataFrame:
    """The windows of giant texts; `row` tells repeated rows apart and stays as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, row = bpe(model).longest, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = MARK + text.as_py().replace(" ", MARK)
                n = -(-len(s) // size)
                for c0 in range(0, n, 64):
                    cuts = [(c, c * size, min(len(s), (c + 1) * size)) for c in range(c0, min(n, c0 + 64))]
                    cols = [[doc_id] * len(cuts), [row] * len(cuts), [c for c, _, _ in cuts], [n] * len(cuts), [s[max(0, a - k) : a] for _, a, _ in cuts], [s[a:b] for _, a, b in cuts], [s[b : b + k] for _, _, b in cuts]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 3], strict=True)], ["doc_id", "row", "chunk", "chunks", "left", "core", "right"])
                row += 1

    return docs.transform(map_arrow, run, "doc_id long, row long, chunk int, chunks int, left string, core string, right string")


def _windows(batch: pa.RecordBatch, m: Bpe) -> Iterator[Chunk]:
    for x in zip(*(batch.column(c).to_pylist() for c in ("left", "core", "right")), strict=True):
        yield Chunk(m, *x)


def _large(docs: DataFrame, model: str, size: int) -> DataFrame:
    cuts = common.written(_cut(docs, model, size).repartition("row", "chunk"), "sentencepiece-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 64):
            flat = [[(*i, *j, v) for i, row in c.matrix().items() for j, v in row.items()] for c in _windows(batch, bpe(model))]
            kind = pa.list_(pa.struct([("i", pa.int32()), ("p", pa.string()), ("j", pa.int32()), ("q", pa.string()), ("v", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array([[dict(zip("ipjqv", e, strict=True)) for e in x] for x in flat], kind)], ["row", "chunk", "m"])

    cells = cuts.transform(map_arrow, matrices, "row long, chunk int, m array<struct<i:int,p:string,j:int,q:string,v:double>>")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "chunk", "i", "p", "j", "q"]

        def solved(row: int, ms: list[Matrix]) -> pa.RecordBatch:
            path = scan(ms)
            return pa.RecordBatch.from_arrays([pa.array([row] * len(path), pa.int64()), pa.array(range(len(path)), pa.int32()), pa.array([s[0][0] for s in path], pa.int32()), pa.array([s[0][1] for s in path]), pa.array([s[1][0] for s in path], pa.int32()), pa.array([s[1][1] for s in path])], names)

        now, ms = None, []
        for batch in batches:
            for row, m in zip(batch.column("row").to_pylist(), batch.column("m").to_pylist(), strict=True):
                if row != now:
                    if ms:
                        yield solved(now, ms)
                    now, ms = row, []
                got: Matrix = {}
                for e in m:
                    got.setdefault((e["i"], e["p"]), {})[e["j"], e["q"]] = e["v"]
                ms.append(got)
        if ms:
            yield solved(now, ms)

    states = cells.repartition("row").sortWithinPartitions("row", "chunk").transform(map_arrow, combine, "row long, chunk int, i int, p string, j int, q string")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 64):
            head = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "chunk", "chunks", "i", "p", "j", "q")), strict=True)
            yield _out([(*h[:4], c.trace((h[4], h[5]), (h[6], h[7]))) for h, c in zip(head, _windows(batch, bpe(model)), strict=True)])

    return cuts.join(states, ["row", "chunk"]).select("doc_id", "row", "chunk", "chunks", "i", "p", "j", "q", "left", "core", "right").transform(map_arrow, trace, _IDS)


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, row, chunk, chunks, ids, whole: one row per text, or per chunk of a text above `chunk` characters. `whole` is a
    constant of either kind, so a filter on it leaves the other kind's encoding out of the plan."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk
    small, large = _small(texts.where(~long), model), _large(texts.where(long), model, chunk)
    return small.withColumn("whole", F.lit(True)).unionByName(large.withColumn("whole", F.lit(False)))


def decode_chunks(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, row, chunk, chunks, n_tokens, s0 and s1 (sums of ids and of ids times their place, modulo PRIME), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe(model)
        for batch in _parts(batches, 128):
            lists, chunk = batch.column("ids"), batch.column("chunk").to_pylist()
            flat = [x.values.to_numpy().astype(np.int64) for x in lists]
            texts = [m.sp.decode([m.lead, *x.tolist()])[1:] if c else m.sp.decode(x.tolist()) for x, c in zip(flat, chunk, strict=True)]
            s1 = [int((x * np.arange(1, len(x) + 1) % PRIME).sum() % PRIME) for x in flat]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "chunk", "chunks")), pa.array([len(x) for x in flat], pa.int64()), pa.array([int(x.sum()) % PRIME for x in flat], pa.int64()), pa.array(s1, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "row", "chunk", "chunks", "n_tokens", "s0", "s1", "text"])

    return encoded.select("doc_id", "row", "chunk", "chunks", "ids").transform(map_arrow, run, "doc_id long, row long, chunk int, chunks int, n_tokens long, s0 long, s1 long, text string")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_chunks, n_tokens, ids_digest (sum of id times its place from 1, modulo PRIME), text.

    Whole texts and chunks are told apart before they are decoded, else either branch would encode and decode all of them."""
    whole = F.col("whole") if "whole" in encoded.columns else F.col("chunks") == 1
    small = decode_chunks(encoded.where(whole), model).select("doc_id", F.lit(1).alias("n_chunks"), "n_tokens", F.col("s1").alias("ids_digest"), "text")
    before = Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    large = decode_chunks(encoded.where(~whole), model).withColumn("at", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) % PRIME)
    large = large.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("chunks").alias("n_chunks"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum((F.col("at") * F.col("s0") + F.col("s1")) % PRIME) % PRIME).alias("ids_digest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "").alias("text"),
    )
    return small.unionByName(large.select("doc_id", "n_chunks", "n_tokens", "ids_digest", "text"))
