"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a lookup of it, in which the minima of nodes with very many links are broadcast, so
that no node's links are gathered in one place; after each step the links are written to the shared folder, which cuts the
lineage. Links that are stars already take no step. Up to `ALONE` links are walked by a single task instead, which spares the
driver the many small jobs of the steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lookup, written
from tessella.shipping import map_arrow

ALONE = 1 << 17

# links: u, v with u > v, each once


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every link (u, v) becomes (u, the least of v and its neighbours). Repeated links stay; the small star merges them."""
    ends = F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("m"), F.lit(0).alias("n")), F.struct(F.col("v"), F.lit(None).cast("long").alias("m"), F.lit(1).alias("n")))
    least = links.select(F.inline(ends)).groupBy("v").agg(F.min("m").alias("m"), F.sum("n").alias("n")).where("m IS NOT NULL AND n > 0")
    return lookup(links, ["v"], least, "n", total).select("u", F.coalesce("m", "v").alias("v"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """A node's smaller neighbours and the node itself are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = lookup(links, ["u"], least, "n", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether they are stars: every node has one link down and none up, or none down."""
    ends = links.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))
    got = nodes.agg(F.sum("down").alias("n"), F.max((F.col("down") > 0) & (F.col("n") > 1)).alias("open")).first()
    return got["n"] or 0, not got["open"]


def _merged(links: Iterable[tuple[int, int]]) -> tuple[dict[int, int], Callable[[int], int]]:
    """The nodes that a link joins to a smaller one, as keys, and the function that gives any node's root."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for u, v in links:
        a, b = top(u), top(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return up, top


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all links of one task."""
    up, top = _merged(_rows(batches))
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def _regrown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root and grown of all rows of one task: u, v, known (v is u's root in the components of before, else a new link)."""
    root: dict[int, int] = {}
    links = []
    for u, v, known in _rows(batches):
        if known:
            root[u] = v
        else:
            links.append((u, v))
    up, top = _merged((root.get(u, u), root.get(v, v)) for u, v in links)
    grown = {top(x) for x in up}
    nodes = list(root.keys() | {x for link in links for x in link})
    roots = [top(root.get(x, x)) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array([x in grown for x in roots], pa.bool_())], ["node", "root", "grown"])


def regrown(before: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """What becomes of the components of before (node, root; roots are nodes too) by new links (u, v): node, root, grown (the
    component has more than one of before's, or of single nodes). None where both are more rows than one task walks."""
    if links.count() + (before.count() if before is not None else 0) > ALONE:
        return None
    rows = links.select("u", "v", F.lit(False).alias("known"))
    if before is not None:
        rows = rows.unionByName(before.select(F.col("node").alias("u"), F.col("root").alias("v"), F.lit(True).alias("known")))
    return rows.repartition(1).transform(map_arrow, _regrown, "node long, root long, grown boolean")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: u, v (long). Returns node, root for all nodes that a link joins to a smaller one; root is the smallest of
    the component. Links of a node with itself and nulls don't count."""
    links = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if links.count() <= ALONE:
        return written(links.repartition(1).transform(map_arrow, _walked, "node long, root long"), "links")
    for _ in range(most_rounds):
        total, settled = _settled(links)
        if settled:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        links = written(_small_star(written(_large_star(links, total), "links"), total), "links")
    raise RuntimeError("components did not settle")
