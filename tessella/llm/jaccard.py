"""Jaccard join on word 5-grams by a MinHash LSH forest with exact verification.

Every text gets the set of hashes of its word 5-grams (a text with fewer words: one hash of all of them). Texts with
equal sets are copies and go on as one representative. Each tree of the forest labels a representative with `MAX_DEPTH`
MinHash values; a node of its trie is what shares a prefix of the label, and nodes with a single leaf are pruned.
Matching begins at the full labels: representatives that share a node are tied, and the components of ties are verified
exactly, on whole sets. Then prefixes are shortened by one value and the components that have grown are verified anew,
until a pair as little similar as the least similar one found so far would have met in some tree with probability
`RECALL` (while none was found, a pair at the threshold counts as such). Shortening ends at the depth where any pair at
the threshold meets with that probability, the deepest cut that a corpus may need.

A component up to a bound of texts and 5-grams is one unit of work, which compares all its pairs. A larger one is cut into
blocks, and two blocks are a unit; every text goes to as many units as there are blocks. Where these are more than the trees, the
component isn't compared as a whole, since its pairs grow with the square of its size: its trie nodes of that last depth are
cut so instead, and a pair is counted in the first tree where it meets. Units send on counts of
links and local components only, never the pairs.

Defined results: null and empty texts and texts without a word have no 5-gram, no copies and no links, and are classes
of their own. Rows with equal sets count as copies, whatever their ids; of rows with one doc_id and different texts each
has its own class and links. A null doc_id comes after all others. Classes and copies are named by their smallest doc_id.
An empty table gives an empty one; other columns, whatever their names, are ignored by `join` and kept by `first_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.components import components, regrown
from tessella.shipping import map_arrow

WORDS, THRESHOLD, TREES, MAX_DEPTH, RECALL = 5, 0.8, 24, 8, 0.999
BLOCK_GRAMS, BLOCK_DOCS = 200_000, 1024


def meets(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """The deepest cut at which every pair at the threshold meets with the target probability."""
    return max((d for d in range(1, max_depth + 1) if meets(threshold, d, trees) >= recall), default=1)


def least_grams(threshold: float) -> int:
    """The size of the smallest set to which a different one can be as similar as the threshold."""
    union = np.ceil(1 / (1 - threshold) - 1e-9) if threshold < 1 else np.inf
    return int(min(1 << 30, max(1, np.ceil(threshold * union - 1e-9))))


def gram_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    h, at = common.word_hashes(texts)
    out = []
    for i in range(len(texts)):
        w = h[at[i] : at[i + 1]]
        out.append(np.unique(common.chains(w, min(k, len(w)))) if len(w) else w)
    return out


class Forest:
    """The random functions of all trees. A tree's label of a set is a run of `depth` MinHash values, kept as two numbers:
    `root`, a hash of the first `top` values, and `rest`, which holds equally many bits of each further value, first ones
    highest. Equal prefixes of d values are thus equal roots and equal high bits of rests."""

    def __init__(self, trees: int = TREES, depth: int = MAX_DEPTH, top: int | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.top = trees, depth, depth if top is None else top
        self.bits = 64 // max(1, depth - self.top)
        self.a = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def labels(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """root and rest of every tree."""
        n = self.trees * self.depth
        sig = np.empty(n, np.uint64)
        step = max(1, (1 << 18) // len(grams))
        if step >= 4:
            for j in range(0, n, step):
                u = slice(j, j + step)
                sig[u] = (self.a[u, None] * grams + self.b[u, None]).min(1)
        else:
            for j in range(n):
                sig[j] = min((self.a[j] * grams[s : s + (1 << 18)] + self.b[j]).min() for s in range(0, len(grams), 1 << 18))
        label = sig.reshape(self.trees, self.depth)
        root = np.arange(1, self.trees + 1, dtype=np.uint64)
        for j in range(self.top):
            root = common.mix(root * np.uint64(0x9E3779B97F4A7C15) + label[:, j])
        rest = np.zeros(self.trees, np.uint64)
        for j in range(self.top, self.depth):
            own = common.mix(label[:, j]) >> np.uint64(64 - self.bits)
            rest = rest << np.uint64(self.bits) | own if j > self.top else own
        return root.view(np.int64), rest.view(np.int64)

    def shift(self, depth: int) -> int:
        """How many low bits of rest lie below a prefix of this depth (one more than top, or longer)."""
        return self.bits * (self.depth - depth)

    def prefix(self, depth: int) -> Column:
        """The bits of column rest that a prefix of this depth has."""
        return F.shiftrightunsigned("rest", self.shift(depth)) if depth > self.top else F.lit(0).cast("long")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))


def _hash() -> Column:
    """With _id() the key of a row; rows that agree in both are one text under one doc_id."""
    return F.xxhash64(F.col("text"), F.col("doc_id").isNull())


def sketches(docs: DataFrame, k: int, forest: Forest) -> DataFrame:
    """did and th (the row's key), doc_id, grams (count), d1, d2 (digests of the set), root, rest (one per tree; empty
    without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, none = ["th", "doc_id", "grams", "d1", "d2", "root", "rest"], np.zeros(0, np.int64)
        for batch in batches:
            for a, b, texts in common.slices(batch, "text"):
                sets = gram_sets(texts, k)
                d1 = np.array([common.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([common.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                labels = zip(*(forest.labels(s) if len(s) else (none, none) for s in sets), strict=True)
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in labels]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names[:2]), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), *lists], names)

    rows = docs.select(_hash().alias("th"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.transform(map_arrow, run, "th long, doc_id long, grams long, d1 long, d2 long, root array<long>, rest array<long>")
    return rows.select(_id().alias("did"), "*")


def meeting(roots: np.ndarray, tree: int) -> np.ndarray:
    """Pairs that share a root in this tree and in none before it. roots: texts x trees."""
    n = len(roots)
    before = np.zeros((n, n), bool)
    for t in range(tree):
        before |= roots[:, t, None] == roots[:, t]
    return (roots[:, tree, None] == roots[:, tree]) & ~before


def verify(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], pairs: np.ndarray | bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links among the pairs of texts (side 2) or between two blocks (sides 0 and 1). Returns per text: documents linked
    (counting copies), the smallest id of its local component and the least similarity of its links (2 where there are none)."""
    n = len(ids)
    size = np.fromiter(map(len, sets), np.int64, n)
    doc = np.repeat(np.arange(n), size)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    g, doc = grams[order], doc[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    run = np.cumsum(new) - 1
    shared = np.bincount(run)[run] > 1  # a 5-gram of one text alone can't be common
    run, doc = run[shared], doc[shared]
    both = np.zeros((n, n), np.float32)  # 5-grams in common
    if len(run):
        col = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
        width = 1024
        cut = np.searchsorted(col, np.arange(0, int(col[-1]) + width + 1, width))
        for j in range(len(cut) - 1):
            part = slice(cut[j], cut[j + 1])
            if cut[j + 1] > cut[j]:
                m = np.zeros((n, width), np.float32)
                m[doc[part], col[part] - j * width] = 1
                live = np.flatnonzero(m.any(1))
                both[np.ix_(live, live)] += m[live] @ m[live].T
    inter = both.astype(np.float64)
    union = size[:, None] + size[None, :] - inter
    linked = pairs & (inter >= threshold * union - 1e-9) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))
    np.fill_diagonal(linked, False)
    links = (linked * copies[None, :]).sum(1)
    low = np.where(linked, inter / union, 2.0).min(1)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    root = rank.copy()
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], n).min(1))
        least = np.minimum(least, least[by_id[least]])
        if (least == root).all():
            return links, ids[by_id[root]], low
        root = least


UNIT = ["unit", "tree", "lo", "hi"]


def _verified(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """rows: UNIT (one group for each value; tree -1 compares all pairs), side, id, copies, roots, text. Returns id, links,
    root, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sets = None, [], []

        def done() -> pa.RecordBatch:
            ids, side, copies = (np.array(c) for c in list(zip(*held, strict=True))[:3])
            pairs = meeting(np.array([h[3].values.to_numpy(zero_copy_only=False) for h in held]), now[1]) if now[1] >= 0 else True
            links, root, low = verify(ids, side, copies, sets, pairs, threshold)
            own = links > 0
            return pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (ids, links.astype(np.int64), root, low)], ["id", "links", "root", "low"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in UNIT), strict=True))
            side, ids, copies = (batch.column(c).to_pylist() for c in ("side", "id", "copies"))
            roots = batch.column("roots")
            for a, b, texts in common.slices(batch, "text"):
                for i, grams in zip(range(a, b), gram_sets(texts, k), strict=True):
                    if keys[i] != now:
                        if len(held) > 1:
                            yield done()
                        now, held, sets = keys[i], [], []
                    held.append((ids[i], side[i], copies[i], roots[i]))
                    sets.append(grams)
        if len(held) > 1:
            yield done()

    dealt = rows.repartition(*UNIT).sortWithinPartitions(*UNIT)
    return dealt.select(*UNIT, "side", "id", "copies", "roots", "text").transform(map_arrow, run, "id long, links long, root long, low double")


def _tied(below: DataFrame, total: int, forest: Forest, depth: int) -> tuple[DataFrame, DataFrame]:
    """One level up the tries: the nodes of this depth (tree, root, rest of any leaf, least id) from those of the next depth, or
    from the leaves; and the ties (u, v) between the least ids of nodes that have become one."""
    node = ["tree", "root", "part"]
    at = below.withColumn("part", forest.prefix(depth))
    nodes = at.groupBy(*node).agg(F.min("least").alias("top"), F.min("rest").alias("rest"), F.count(F.lit(1)).alias("n"))
    nodes = common.written(nodes, "forest-nodes")
    ties = common.lookup(at.drop("rest"), node, nodes.where("n > 1").select(*node, "top", "n"), "n", total)
    ties = ties.where("least != top").select(F.col("least").alias("u"), F.col("top").alias("v"))
    return nodes.select("tree", "root", "rest", F.col("top").alias("least")), ties


def _grow(before: DataFrame | None, ties: DataFrame, total: int) -> DataFrame:
    """Components (node, root, grown) after new ties. Ties are drawn between the components of before, so that what has been
    joined isn't walked again; grown says whether a component has more than one of before's, or of single representatives.
    Few ties and nodes are left to one task, which spares the driver some twenty shuffles and broadcasts."""
    ties = common.written(ties.distinct(), "forest-ties")
    few = regrown(before, ties)
    if few is not None:
        return common.written(few, "forest-components")
    if before is not None:
        for end in ("u", "v"):
            ends = ties.groupBy(end).agg(F.count(F.lit(1)).alias("n")).join(before.withColumnRenamed("node", end), end)
            ties = common.lookup(ties, [end], ends, "n", total).withColumn(end, F.coalesce("root", end)).select("u", "v")
    new = components(ties)
    new = new.unionByName(new.select(F.col("root").alias("node"), "root").distinct())
    if before is None:
        return common.written(new.withColumn("grown", F.lit(True)), "forest-components")
    rows = common.written(before.unionByName(new.select("node", F.col("node").alias("root"))).distinct(), "forest-before")
    moved = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(new.select(F.col("node").alias("root"), F.col("root").alias("new")), "root")
    found = common.lookup(rows, ["root"], moved, "n", total)
    return common.written(found.select("node", F.coalesce("new", "root").alias("root"), F.col("new").isNotNull().alias("grown")), "forest-components")


def _blocked(rows: DataFrame, rest: list[str]) -> DataFrame:
    """UNIT, side and rest of rows (unit, tree, n and g of the unit, id, rest), each once for every block its own is compared with."""
    zero, blocks = F.lit(0), _blocks()
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return rows.select("unit", "tree", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), side.alias("side"), *rest)


def _blocks() -> Column:
    return F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")


def _units(found: DataFrame, reps: DataFrame, trees: int) -> DataFrame:
    """The units of work for some components: UNIT, side, id, did, th, copies, roots. A component of no more blocks than there are
    trees has all its blocks compared, so that no text is sent to more units than that; a larger one goes by its nodes."""
    kept, maybe = common.sieve(reps.select("id", "did", "th", "grams", "copies", F.col("root").alias("roots")), F.col("id"), found.select("node"))
    members = kept.where(maybe).drop(maybe).join(found.select(F.col("node").alias("id"), F.col("root").alias("unit")), "id")
    members = common.written(members, "forest-members")
    sizes = common.written(members.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("g")), "forest-sizes")
    units, count, most = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.max(_blocks())).first()
    members, rest = common.lookup(members, ["unit"], sizes, "n", count or 0, units), ["id", "did", "th", "copies", "roots"]
    if (most or 0) <= trees:
        return _blocked(members.withColumn("tree", F.lit(-1)), rest)
    few = _blocks() <= trees
    whole = _blocked(members.where(few).withColumn("tree", F.lit(-1)), rest)
    giant = common.written(members.where(~few).select("grams", *rest), "forest-giants")
    inner = giant.select("*", F.posexplode("roots").alias("tree", "unit"))
    sizes = inner.groupBy("tree", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("g"))
    inner = common.lookup(inner, ["tree", "unit"], sizes, "n", count * trees).where("n > 1")
    return whole.unionByName(_blocked(inner, rest))


def _links(docs: DataFrame, leaves: DataFrame, reps: DataFrame, k: int, threshold: float, recall: float, forest: Forest) -> DataFrame:
    """id, links, root, low, depth of all units of all depths."""
    out, low, before, total = None, 2.0, None, leaves.count()
    nodes = leaves.select("tree", "root", "rest", F.col("id").alias("least"))
    for depth in range(forest.depth, forest.top - 1, -1):
        if not total:
            break
        nodes, ties = _tied(nodes, total, forest, depth)
        found = _grow(before, ties, total)
        before, grown = found.select("node", "root"), found.where("grown").select("node", "root")
        if grown.isEmpty():
            continue
        units = common.written(_units(grown, reps, forest.trees), "forest-units")
        rows, maybe = common.sieve(docs.select(_id().alias("did"), _hash().alias("th"), "text"), F.xxhash64("did", "th"), units.select(F.xxhash64("did", "th")))
        texts = rows.where(maybe).groupBy("did", "th").agg(F.first("text").alias("text"))  # repeated rows combine before the shuffle
        got = common.written(_verified(units.join(texts, ["did", "th"]), k, threshold), "forest-links").withColumn("depth", F.lit(depth))
        out = got if out is None else out.unionByName(got)
        low = min(low, got.agg(F.min("low")).first()[0] or 2.0)
        if low <= 1 and meets(low, depth, forest.trees) >= recall:
            break
    return docs.sparkSession.createDataFrame([], "id long, links long, root long, low double, depth int") if out is None else out


SET = ["grams", "d1", "d2"]


def _rows(docs: DataFrame, k: int, threshold: float, trees: int, max_depth: int, recall: float) -> DataFrame:
    """Every row's did, th, doc_id, the first row of its copies (copy) and of its class (least), and n_links."""
    forest = Forest(trees, max_depth, least_depth(threshold, trees, max_depth, recall))
    seen = common.written(sketches(docs, k, forest), "forest-sketches")
    total = seen.count()
    row = F.struct(F.col("doc_id").isNull().alias("none"), "did", "th")
    reps = seen.where("grams > 0").groupBy(*SET).agg(F.min(row).alias("copy"), F.count(F.lit(1)).alias("copies"), F.first("root").alias("root"), F.first("rest").alias("rest"))
    reps = common.written(reps.select(F.monotonically_increasing_id().alias("id"), *SET, "copy", "copy.did", "copy.th", "copies", "root", "rest"), "forest-sets")

    leaves = reps.where(F.col("grams") >= least_grams(threshold)).select("id", F.posexplode(F.arrays_zip("root", "rest")).alias("tree", "label")).select("id", "tree", "label.root", "label.rest")
    node = F.xxhash64("tree", "root")
    shared = leaves.groupBy("tree", "root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(node)
    leaves, maybe = common.sieve(leaves, node, shared)
    leaves = common.written(leaves.where(maybe).drop(maybe), "forest-leaves")

    found = _links(docs, leaves, reps, k, threshold, recall, forest)
    links = found.groupBy("id", "depth").agg(F.sum("links").alias("links")).groupBy("id").agg(F.min_by("links", "depth").alias("links"))  # the last unit holds
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    roots = common.written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "forest-classes")
    sets = reps.select("id", *SET, "copy", "copies").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    sets = common.written(sets.withColumn("root", F.coalesce("root", "id")), "forest-tied")
    least = sets.groupBy("root").agg(F.min("copy").alias("least"), F.count(F.lit(1)).alias("n"))
    sets = common.lookup(sets, ["root"], least, "n", total)
    sets = sets.select(*SET, "copies", "copy", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    slim = seen.select("did", "th", "doc_id", *SET)
    worded = common.lookup(slim.where("grams > 0"), SET, common.written(sets, "forest-results"), "copies", total)
    alone = slim.where("grams = 0").select("did", "th", "doc_id", row.alias("copy"), row.alias("least"), F.lit(0).cast("long").alias("n_links"))
    return worded.select("did", "th", "doc_id", "copy", "least", "n_links").unionByName(alone)


def join(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its component of links), copy_id (smallest doc_id with
    the same set), n_links (other rows whose similarity reaches the threshold)."""
    name = lambda c: F.when(~F.col(f"{c}.none"), F.col(f"{c}.did"))
    rows = _rows(docs, k, threshold, trees, max_depth, recall)
    return rows.select("doc_id", name("least").alias("class_id"), name("copy").alias("copy_id"), "n_links")


def first_rows(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> DataFrame:
    """The rows of docs, all columns, that come first in their class: the smallest doc_id, of rows that share it one."""
    rows = common.written(_rows(docs, k, threshold, trees, max_depth, recall).select("did", "th", "least"), "forest-rows")
    first = (F.col("least.did") == F.col("did")) & (F.col("least.th") == F.col("th"))
    gone = common.written(rows.where(~first).select("th", "did").distinct(), "forest-gone")
    again = rows.where(first).groupBy("th", "did").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("th", "did")
    keys = [_hash(), _id()]
    return common.once(common.without(docs, keys, gone), keys, again)
