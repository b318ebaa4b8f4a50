"""Exact deduplication by owners in Patricia tries.

Texts are compared after replacing each run of [\\x20\\x09-\\x0D] by one space. Every map task first inserts its texts
into a trie, so that a group of copies leaves it once per task; what remains is dealt by (length, content hash), and
each partition inserts the full byte strings into a compressed radix trie whose terminal nodes hold the smallest
identifier and the number of rows. When a trie's bytes pass a budget, its largest subtree is spilled: its terminals are
sent on as partial owners (without text) and the subtree is freed; partial owners of one text meet in a final sum.
Rows then find their owner by (length, digest); owners of very many rows are broadcast, so no group meets in one task.

Defined results: null counts as empty; empty texts equal each other; the smallest doc_id (a null one only if all are
null) owns the group. Every row gets a row, and exactly one of a group is kept: of rows that repeat the owner's doc_id
and text, one. An empty table gives an empty one; other columns, whatever their names, are ignored by `dedup` and
kept by `first_rows`. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.shipping import map_arrow

BUDGET = 32 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Node:
    __slots__ = ("children", "least", "rows", "size", "tail", "text", "ties")

    def __init__(self, text: bytes, tail: int):
        self.text, self.tail = text, tail  # the edge into this node is text[parent's tail : tail]
        self.children: dict[int, Node] | None = None
        self.least, self.ties, self.rows = None, 0, 0  # smallest identifier, rows that have it, all rows
        self.size = 0  # bytes of the texts that end at or below; kept for children of the root


class PatriciaTrie:
    """Byte strings with a smallest identifier and a row count each. Edges point into the inserted strings."""

    def __init__(self, budget: int = BUDGET):
        self.root, self.bytes, self.budget = Node(b"", 0), 0, budget

    def insert(self, text: bytes, least: int | None, ties: int, rows: int) -> None:
        node, at, n = self.root, 0, len(text)
        while at < n:
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text, n)
                self._grow(text)
                node, at = child, n
                break
            end = child.tail
            if text[at:end] == child.text[at:end]:
                node, at = child, end
                continue
            lo, hi = at, min(n, end)  # the first difference lies in (at, hi]
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if text[at:mid] == child.text[at:mid]:
                    lo = mid
                else:
                    hi = mid - 1
            fork = Node(text, lo)
            fork.children = {child.text[lo]: child}
            fork.size = child.size
            node.children[text[at]] = fork
            if lo == n:
                self._grow(text)
            node, at = fork, lo
        if node.rows and least == node.least:
            node.ties += ties
        elif not node.rows or (least is not None and (node.least is None or least < node.least)):
            node.least, node.ties = least, ties
        node.rows += rows

    def _grow(self, text: bytes) -> None:
        self.bytes += len(text) + 200
        if text:
            self.root.children[text[0]].size += len(text) + 200

    def over(self) -> bool:
        return self.bytes > self.budget

    def spill(self) -> Iterator[tuple[bytes, int | None, int, int]]:
        """Take out the largest subtree below the root and hand out its terminals."""
        first = max(self.root.children, key=lambda c: self.root.children[c].size)
        gone = self.root.children.pop(first)
        self.bytes -= gone.size
        yield from self.terminals(gone)

    def terminals(self, top: Node | None = None) -> Iterator[tuple[bytes, int | None, int, int]]:
        stack = [top or self.root]
        while stack:
            node = stack.pop()
            if node.rows:
                yield node.text[: node.tail], node.least, node.ties, node.rows
            if node.children:
                stack.extend(node.children.values())


def _owners(with_text: bool, budget: int):
    names = ["n_bytes", "text_sha256", "least", "ties", "rows"] + ["text"] * with_text
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_text

    def batch(items: list[tuple]) -> pa.RecordBatch:
        texts, *numbers = zip(*items, strict=True)
        cols = [list(map(len, texts)), [hashlib.sha256(t).hexdigest() for t in texts], *numbers] + [texts] * with_text
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def batches(items: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for item in items:
            held.append(item)
            size += len(item[0])
            if len(held) >= 5000 or size > 4 << 20:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for b in rows:
            text, numbers = b.column("text"), zip(*(b.column(c).to_pylist() for c in ("least", "ties", "rows")), strict=True)
            for i, n in enumerate(numbers):
                trie.insert(text[i].as_py(), *n)
                while trie.over():
                    yield from batches(trie.spill())
        yield from batches(trie.terminals())

    return run, ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "string", "long", "long", "long"] + ["binary"] * with_text, strict=True))


KEY = ["n_bytes", "text_sha256"]


def owners(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per distinct normalised text: n_bytes, text_sha256, keep_id, keep_rows (rows with that doc_id), group_size."""
    one = F.lit(1).cast("long")
    rows = docs.select(normalised(F.col("text")).cast("binary").alias("text"), F.col("doc_id").cast("long").alias("least"), one.alias("ties"), one.alias("rows"))
    local, schema = _owners(True, min(budget, 16 << 20))
    once = rows.transform(map_arrow, local, schema)
    dealt = once.repartition(F.col("n_bytes"), F.xxhash64("text_sha256"))
    own, schema = _owners(False, budget)
    parts = dealt.select("text", "least", "ties", "rows").transform(map_arrow, own, schema).repartition(*KEY)
    parts = parts.groupBy(*KEY, "least").agg(F.sum("ties").alias("ties"), F.sum("rows").alias("rows"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "ties"))  # null identifiers come last
    return parts.groupBy(*KEY).agg(first.alias("first"), F.sum("rows").alias("group_size")).select(*KEY, F.col("first.least").alias("keep_id"), F.col("first.ties").alias("keep_rows"), "group_size")


def _sha(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _placed(docs: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, n_bytes, text_sha256) with its group's owner, and the owners of groups of two rows or more."""
    norm = normalised(F.col("text")).cast("binary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(norm).cast("long").alias("n_bytes"), F.sha2(norm, 256).alias("text_sha256"))
    keyed = common.written(keyed, "dedup-rows")
    own = common.written(owners(docs, budget).where("group_size > 1"), "dedup-owners")
    return common.lookup(keyed, KEY, own, "group_size", keyed.count()), own


TIES = 100_000


def dedup(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    placed, own = _placed(docs, budget)
    alone, owner = F.col("group_size").isNull(), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    plain = placed.where(alone | ~owner | (F.col("keep_rows") == 1)).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | owner).alias("kept"), "text_sha256"
    )
    # Rows that repeat their owner are equal in all columns here; they are counted out again, TIES at a time, the first one kept.
    tied = own.where("keep_rows > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keep_rows") - 1, F.lit(TIES).cast("long"))))
    tied = tied.repartition("text_sha256", "at").withColumn("i", F.explode(F.sequence("at", F.least(F.col("at") + TIES, F.col("keep_rows")) - 1)))
    return plain.unionByName(tied.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("i") == 0).alias("kept"), "text_sha256"))


def first_rows(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of docs that are kept, with all columns."""
    placed, own = _placed(docs, budget)
    gone = placed.where(F.col("group_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    keys = [F.col("doc_id").cast("long"), _sha(F.col("text"))]
    left = common.without(docs, keys, common.written(gone, "dedup-gone"))
    return common.once(left, keys, own.where("keep_rows > 1").select("keep_id", "text_sha256"))
