"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a word model of order two with absolute discount. What the discount leaves of a history
goes to the class's single words, which count by how many distinct words stand before them in the class, and what it leaves
of these to one backoff distribution that both classes share: the continuation counts of both together. A class's pairs have
a probability of their own where the class holds them more than `DISCOUNT` times. A word that neither class has behind more
than `DISCOUNT` words is scored by the shared backoff alone, and its ratio is one constant. The counts are of all labelled
rows but the held-out and the calibrating ones. Only words' evidence above the least margin counts below, so pairs that stay
under it with and without an entry are left out of the table, which changes no score.

A word's evidence is the lesser of its log-likelihood ratios with and without its history, since pairs are soon learned by
heart from copies of one text. A text's is the sum of what exceeds a margin, over the square root of its words; it is
turned into a probability by one logistic map. Margin and map are chosen on the calibrating rows.

About `HEAD` of the most frequent entries are broadcast; rarer ones stay a table that is joined with the texts' words,
so the split changes no score.

Defined results: null and empty texts, and texts without words, have no evidence and get the least score there is;
without labels of both classes every score is 0 and no row is rejected. Labels that are not 0 or 1 are ignored; a document
labelled twice counts as toxic if one label says so. Repeated rows are counted and scored each, and alike. An empty table
gives an empty one; texts are read whole, in slices; other columns, whatever their names, are ignored by `score` and kept
by `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.shipping import map_arrow, ship

DISCOUNT = 1.5
MARGINS = (1.0, 1.5, 2.0, 2.5, 3.0)
HEAD = 1 << 21
ROWS_PER_BUCKET, WIDE, HELD = 2000, 1024, 1 << 19


def pair_key(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix(prev * np.uint64(0x9E3779B97F4A7C15) + word)


def history_key(prev: np.ndarray) -> np.ndarray:
    return common.mix(prev ^ np.uint64(0x5851F42D4C957F2D))


def histories(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word before each word, 0 for a text's first."""
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[at[:-1][np.diff(at) > 0]] = 0
    return prev


def _summed(word: np.ndarray, prev: np.ndarray, tox: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((prev, word))
    word, prev, tox, other = (x[order] for x in (word, prev, tox, other))
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (prev[1:] != prev[:-1])]))
    return [word[new], prev[new], np.add.reduceat(tox, new), np.add.reduceat(other, new)]


_PAIRS = "bucket int, word array<long>, prev array<long>, tox array<int>, ord array<int>, size array<int>"
_SUMS = ("cont", "ct", "co", "tox", "ord")
_COUNTS = "kind int, word long, prev long, " + ", ".join(f"{c} long" for c in _SUMS)


def counts(docs: DataFrame, wide: np.ndarray, buckets: int) -> DataFrame:
    """What the models are made of, from docs (text, toxic): word, cont (distinct words before it), ct, co (those by class), tox,
    ord (its count by class) with kind 0, and pairs (prev, word) that a class holds more than DISCOUNT times, with kind 2 where
    toxic texts do and 3 where only ordinary ones do.

    A task sums its pairs and sends them in arrays to the bucket of their word; pairs of `wide` words, which are frequent, go
    to the bucket of the pair, and their sums meet once more."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            word, prev, tox, other = _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            place = np.where(np.isin(word, wide), common.mix(word ^ prev * np.uint64(3)), word)
            bucket = ((place >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            word, prev, tox, other, bucket = (x[order] for x in (word, prev, tox, other, bucket))
            edge = np.append(np.searchsorted(bucket, np.unique(bucket)), len(bucket))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                new = np.flatnonzero(np.concatenate([[True], word[a + 1 : b] != word[a : b - 1]]))
                cols = [
                    word[a:b][new].view(np.int64), prev[a:b].view(np.int64),
                    tox[a:b].astype(np.int32), other[a:b].astype(np.int32), np.diff(np.append(new, b - a)).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 1]), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in cols)], ["bucket", "word", "prev", "tox", "ord", "size"])

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, texts in common.slices(batch, "text"):
                h, at = common.word_hashes(texts)
                if len(h):
                    t = np.repeat(toxic[a : a + len(texts)], np.diff(at))
                    held.append(_summed(h, histories(h, at), t, 1 - t))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD // 2:
                        yield from sent()
                        held = []
        if held:
            yield from sent()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> pa.RecordBatch:
            word, prev, tox, other = _summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            pair = np.flatnonzero((np.maximum(tox, other) > DISCOUNT) & (prev != 0))  # not those at a text's start
            kind = np.append(np.where(np.isin(word[first], wide), 1, 0), np.where(tox[pair] > DISCOUNT, 2, 3)).astype(np.int32)
            own = [np.add.reduceat(x, first) for x in (np.ones_like(tox), (tox > 0).astype(np.int64), (other > 0).astype(np.int64), tox, other)]
            none = np.zeros(len(pair), np.int64)
            cols = [np.append(word[first], word[pair]).view(np.int64), np.append(np.zeros(len(first), np.uint64), prev[pair]).view(np.int64)]
            cols += [np.append(x, y) for x, y in zip(own, (none, none, none, tox[pair], other[pair]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(c) for c in cols)], ["kind", "word", "prev", *_SUMS])

        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    if parts:
                        yield out()
                    now, parts = bucket, []
                word, prev, tox, other, size = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("word", "prev", "tox", "ord", "size"))
                parts.append([np.repeat(word.view(np.uint64), size), prev.view(np.uint64), tox.astype(np.int64), other.astype(np.int64)])
        if parts:
            yield out()

    pairs = docs.select("text", F.col("toxic").cast("long").alias("toxic")).transform(map_arrow, local, _PAIRS)
    got = common.written(pairs.repartition("bucket").sortWithinPartitions("bucket").transform(map_arrow, merged, _COUNTS), "toxicity-parts")
    parts = got.where("kind = 1").groupBy("word").agg(*(F.sum(c).alias(c) for c in _SUMS))
    parts = parts.select(F.lit(0).alias("kind"), "word", F.lit(0).cast("long").alias("prev"), *_SUMS)
    return got.where("kind != 1").unionByName(parts)


def entries(got: DataFrame, continued: bool = False) -> tuple[DataFrame, float] | None:
    """(key, ratio, size) of all words, pairs and histories that need an entry, and the ratio of other words; None without
    words of both classes. got: counts().

    continued: Kneser-Ney, as `fit` takes it. A class's single words go by how many words stand before them in the class, and
    pairs of either class have a probability of their own. Pairs whose evidence is below all margins with and without an entry get
    none. Otherwise single words go by occurrence, and only pairs of toxic texts count."""
    words = got.where("kind = 0")
    low = ("ct", "co") if continued else ("tox", "ord")
    left = [F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))) for c in low]
    tot = words.agg(F.sum(low[0]).alias("nt"), F.sum(low[1]).alias("no"), left[0].alias("lt"), left[1].alias("lo"), F.sum("cont").alias("cont"), F.count(F.lit(1)).alias("v")).first()
    if not tot["nt"] or not tot["no"]:
        return None
    back = (F.col("cont") + 0.5) / (tot["cont"] + 0.5 * (tot["v"] + 1))
    lam_t, lam_o = tot["lt"] / tot["nt"], tot["lo"] / tot["no"]
    over = lambda c: F.greatest(F.col(c) - F.lit(DISCOUNT), F.lit(0.0))
    own = F.greatest(*low) > DISCOUNT
    words = words.select("word", "tox", "ord", own.alias("own"), (over(low[0]) / tot["nt"] + lam_t * back).alias("pt"), (over(low[1]) / tot["no"] + lam_o * back).alias("po"))
    ratio = lambda a, b: F.log(a / b).cast("float").alias("ratio")
    size = F.floor(8 * F.log2(F.col("tox") + F.col("ord"))).alias("size")
    single = words.where("own").select(F.col("word").alias("key"), ratio(F.col("pt"), F.col("po")), size)

    pairs = got.where(F.col("kind").isin(2, 3) if continued else F.col("kind") == 2).select("word", "prev", "tox", "ord", over("tox").alias("ot"), over("ord").alias("oo"))
    before = pairs.groupBy("prev").agg(F.sum("ot").alias("st"), F.sum("oo").alias("so"), F.count(F.lit(1)).alias("n"))
    before = before.join(words.select(F.col("word").alias("prev"), F.col("tox").alias("ht"), F.col("ord").alias("ho")), "prev")
    # ends of texts count as words, so a history is followed as often as it occurs
    rest = lambda s, h: F.when(F.col(h) > 0, 1 - F.col(s) / F.col(h)).otherwise(1.0)
    before = common.written(before.withColumn("bt", rest("st", "ht")).withColumn("bo", rest("so", "ho")), "toxicity-histories")
    total = pairs.count()
    pairs = common.lookup(pairs, ["prev"], before.select("prev", "ht", "ho", "bt", "bo", "n"), "n", total).drop("n")
    ends = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(words.select("word", "pt", "po"), "word")
    pairs = common.lookup(pairs, ["word"], ends, "n", total)
    own_t = F.when(F.col("ht") > 0, F.col("ot") / F.col("ht")).otherwise(0.0)
    own_o = F.when(F.col("ho") > 0, F.col("oo") / F.col("ho")).otherwise(0.0)
    word = F.log(F.col("pt") / F.col("po"))
    most = F.least(word, F.greatest("ratio", F.log(F.col("bt") / F.col("bo")) + word))
    both = pairs.select("word", "prev", ratio(own_t + F.col("bt") * F.col("pt"), own_o + F.col("bo") * F.col("po")), size, "pt", "po", "bt", "bo")
    both = both.where(most > MARGINS[0] - 1e-3) if continued else both
    both = both.select("word", "prev", "ratio", "size")
    after = before.select(F.lit(None).cast("long").alias("word"), "prev", ratio(F.col("bt"), F.col("bo")), F.floor(8 * F.log2(F.col("ht") + F.col("ho"))).alias("size"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prev = batch.column("prev").to_numpy().view(np.uint64)
            word = batch.column("word").fill_null(0).to_numpy().view(np.uint64)
            key = np.where(batch.column("word").is_null().to_numpy(zero_copy_only=False), history_key(prev), pair_key(prev, word))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("ratio"), batch.column("size")], ["key", "ratio", "size"])

    return single.unionByName(both.unionByName(after).transform(map_arrow, keyed, "key long, ratio float, size long")), float(np.log(lam_t / lam_o))


class Model:
    """keys: sorted keys of entries; ratio: log P(toxic) - log P(ordinary) of each; rest: that of words without one.
    tail: (key, ratio) of the rarer entries as a table, or None; it stays with the driver's copy."""

    def __init__(self, keys: np.ndarray, ratio: np.ndarray, rest: float = 0.0, tail: DataFrame | None = None):
        self.keys, self.ratio, self.rest, self.tail = keys, ratio, rest, tail
        self.margin, self.slope, self.base = MARGINS[-1], 0.0, 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tail": None}

    @staticmethod
    def of(own: DataFrame, rest: float, head: int = HEAD) -> Model:
        """own: entries(). The head is taken by size, and holds at most `head` entries."""
        least, n, rare = None, 0, False
        for r in sorted(own.groupBy("size").count().collect(), reverse=True):
            n += r["count"]
            if n > head:
                least, rare = r["size"] + 1, True
                break
        top = (own.where(F.col("size") >= least) if rare else own).select("key", "ratio").toArrow()
        keys = top.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return Model(keys[order], top.column("ratio").to_numpy()[order], rest, own.where(F.col("size") < least).select("key", "ratio") if rare else None)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ratios, NaN where there is no entry."""
        if not len(self.keys):
            return np.full(len(keys), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ratio[at], np.float32(np.nan))

    def evidence(self, texts: list[bytes], rare: Model | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The evidence of every word of the texts, and the offsets of the texts. rare: the entries of the tail they need."""
        h, at = common.word_hashes(texts)

        def find(keys: np.ndarray) -> np.ndarray:
            got = self.find(keys)
            return got if rare is None else np.where(np.isnan(got), rare.find(keys), got)

        single = find(h)
        single = np.where(np.isnan(single), np.float32(self.rest), single)
        if not len(h):
            return single, at
        prev = histories(h, at)
        after = find(history_key(prev))
        known = np.flatnonzero(~np.isnan(after))
        pair = find(pair_key(prev[known], h[known]))
        out = single.copy()
        out[known] = np.minimum(single[known], np.where(np.isnan(pair), single[known] + after[known], pair))
        return out, at

    def features(self, texts: list[bytes], margins: tuple[float, ...], rare: Model | None = None) -> np.ndarray:
        """Per text and margin: what the evidence of its words exceeds the margin by, over the root of their number."""
        x, at = self.evidence(texts, rare)
        out = np.zeros((len(texts), len(margins)))
        n = np.diff(at)
        full = np.flatnonzero(n)
        for j, m in enumerate(margins):
            if len(full):
                out[full, j] = np.sqrt(np.add.reduceat(np.maximum(x.astype(np.float64) - m, 0), at[:-1][full]) / np.sqrt(n[full]))
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, margins: tuple[float, ...] = MARGINS, ridge: float = 0.01) -> None:
        """The margin, and the rising logistic map of its feature, under which labels are likeliest."""
        best = -np.inf
        for m, v in zip(margins, x.T, strict=True):
            z = np.c_[v, np.ones(len(v))]
            w = np.zeros(2)
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                w -= np.clip(np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (weight * (p - y)) + ridge * w), -2, 2)
            likely = -(weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w))).sum()
            if likely > best:
                best, self.margin, self.slope, self.base = likely, m, max(0.0, float(w[0])), float(w[1])

    def score(self, texts: list[bytes], rare: Model | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.features(texts, (self.margin,), rare)[:, 0] + self.base, -30, 30)))


def with_rare(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned too: the entries (key, ratio) of the model's tail that the row's text
    needs, or null."""
    sha, rare = common.fresh("sha", "rare")
    if model.tail is None:
        return docs.withColumn(rare, F.lit(None).cast("array<struct<key: bigint, ratio: float>>")), rare
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in common.slices(batch, "text"):
                h, at = common.word_hashes(texts)
                prev, row = histories(h, at) if len(h) else h, np.repeat(np.arange(a, a + len(texts)), np.diff(at))
                keys, row = np.concatenate([h, history_key(prev), pair_key(prev, h)]), np.tile(row, 3)
                far = np.isnan(sent.value.find(keys))
                yield pa.RecordBatch.from_arrays([batch.column("sha").take(pa.array(row[far])), pa.array(keys[far].view(np.int64))], ["sha", "key"])

    digest = F.sha2(F.col("text").cast("binary"), 256)
    asked, maybe = common.sieve(docs.select("text", digest.alias("sha")).transform(map_arrow, unknown, "sha string, key long"), F.col("key"), model.tail.select("key"))
    asked = asked.where(maybe).drop(maybe).distinct()
    found = asked.join(model.tail, "key").groupBy("sha").agg(F.collect_list(F.struct("key", "ratio")).alias(rare)).withColumnRenamed("sha", sha)
    [own] = common.fresh("own")
    return docs.withColumn(own, digest).join(found, F.col(own) == F.col(sha), "left").drop(own, sha), rare


def rare_of(column: pa.Array) -> Model | None:
    """The entries of with_rare()'s column; a key's ratio is the same in every row."""
    if column.null_count == len(column):
        return None
    got = column.flatten()
    keys, first = np.unique(got.field("key").to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
    return Model(keys, got.field("ratio").to_numpy(zero_copy_only=False)[first])


def wide_words(rows: DataFrame, share: float = 1 / 4096) -> np.ndarray:
    """Up to WIDE words that make up more than this share of a sample's words. What they are decides where pairs are summed, not
    what is counted."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in common.slices(batch, "text"):
                w, n = np.unique(common.word_hashes(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    seen = rows.select("text").transform(map_arrow, words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    top = seen.where(F.col("n") > share * total).orderBy(F.desc("n")).limit(WIDE).collect()
    return np.array([r["word"] for r in top], np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 6000, most_ordinary: int = 18000, head: int = HEAD) -> Model | None:
    """Count words and pairs of all labelled rows but those whose crc32(doc_id) mod 5 is 0 and those that calibrate: the rows
    where it is 4 among about most_toxic and most_ordinary labelled ones (chosen by a hash of doc_id; fewer where there are fewer)."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (common.fold("doc_id", 5) != 0))
    known = common.written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    n = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    most = {1: most_toxic, 0: most_ordinary}
    cut = [common.thin(known.where(F.col("toxic") == c), F.col("doc_id"), {c: n[c]}, most[c], F.col("toxic")) for c in n]
    sample = common.written(cut[0].unionByName(cut[1]).where(common.fold("doc_id", 5) == 4), "toxicity-sample")
    rest = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")  # the sample is bounded
    texts = docs.select("doc_id", "text")
    rows = common.written(texts.join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-calibration")
    marked, maybe = common.sieve(texts, F.col("doc_id"), rest.select("doc_id"))
    counted = marked.where(maybe).drop(maybe).hint("merge").join(rest.hint("merge"), "doc_id")
    got = common.written(counts(counted, wide_words(rows), max(64, sum(n.values()) // ROWS_PER_BUCKET)), "toxicity-counts")
    made = entries(got, continued=True)
    if made is None:
        return None
    model = Model.of(common.written(made[0], "toxicity-entries"), made[1], head)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in common.slices(batch, "text"):
                x = model.features(texts, MARGINS, rare_of(batch.column("rare").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), *(pa.array(x[:, j]) for j in range(len(MARGINS)))], ["toxic", *(f"x{j}" for j in range(len(MARGINS)))])

    rows, rare = with_rare(rows, model)
    seen = rows.withColumnRenamed(rare, "rare").transform(map_arrow, measure, "toxic int, " + ", ".join(f"x{j} double" for j in range(len(MARGINS)))).toPandas()
    y = seen["toxic"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    share = {c: n[c] / sum(n.values()) for c in n}
    weight = np.where(y == 1, share[1] / y.mean(), share[0] / (1 - y.mean()))
    model.calibrate(seen[[f"x{j}" for j in range(len(MARGINS))]].to_numpy(), y, weight)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    if model is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the head of fit()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in common.slices(batch, "text"):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sent.value.score(texts, rare_of(batch.column("rare").slice(a, b - a))))], ["doc_id", "score"])

        rows, rare = with_rare(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
        scored = rows.withColumnRenamed(rare, "rare").transform(map_arrow, run, "doc_id long, score double")
    return scored.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    if model is None:
        return docs
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array, rare: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.array([bool(p < 0.5) for a, b, texts in common.slices(batch, "text") for p in sent.value.score(texts, rare_of(rare.slice(a, b - a)))], pa.bool_())

    rows, rare = with_rare(docs, model)
    return rows.where(clean(F.col("text"), F.col(rare))).drop(rare)
