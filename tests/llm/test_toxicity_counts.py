"""What the word models gather grows with the labelled rows and equals plain counts; the broadcast head changes no score."""

import re
import zlib
from collections import Counter, defaultdict
from math import log, sqrt

import numpy as np
import pytest

from tessella.llm import common, toxicity


def corpus(spark, n=6000):
    docs = spark.range(n).selectExpr("id as doc_id", "case when id % 4 = 0 then concat('you are a zorgle', id % 400, ' and a fool') else concat('the garden has plum', id % 400, ' and a tree') end as text")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "int(id % 4 = 0) as toxic")
    return docs, labels


def test_counts_cover_all_labelled_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels, most_toxic=150, most_ordinary=150)
    # 100 words zorgle and 300 plum stand in 15 rows each, about 12 of them not held out; a sample of 300 rows holds one or none of most
    assert model.tail is None and len(model.keys) >= 400 + 6


def test_rare_words_are_joined(spark):
    docs, labels = corpus(spark)
    docs = docs.unionByName(spark.createDataFrame([(None, None), (7, ""), (None, "zorgle4 zorgle8")], "doc_id long, text string"))
    whole, split = toxicity.fit(docs, labels, 150, 150), toxicity.fit(docs, labels, 150, 150, head=10)
    assert split.tail is not None and len(split.keys) <= 10 and split.tail.count() + len(split.keys) == len(whole.keys)
    rows = lambda m: sorted(((r.doc_id or -1, round(r.score, 9)) for r in toxicity.score(docs, m).collect()))
    assert rows(whole) == rows(split) and len(rows(split)) == 6003
    kept = [sorted(toxicity.accepted(docs, m).collect(), key=repr) for m in (whole, split)]
    assert kept[0] == kept[1] and toxicity.accepted(docs, split).columns == docs.columns


@pytest.mark.parametrize("wide", [0, 5])
def test_scores_equal_a_plain_model(spark, wide):
    """Counts, backoff, ratios and evidence against dictionaries of words."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (common.table(spark, sf, t) for t in ("documents", "labels"))
    rows = [(r.text or "", r.toxic) for r in docs.join(labels, "doc_id").collect()]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    one, two, before = [Counter(), Counter()], [Counter(), Counter()], defaultdict(set)
    for t, toxic in rows:
        w = words(t)
        one[toxic].update(w)
        two[toxic].update(zip(w, w[1:]))
        for a, b in zip(["", *w], w):
            before[b].add(a)
    d, v, types = toxicity.DISCOUNT, len(before), sum(map(len, before.values()))
    back = {w: (len(b) + 0.5) / (types + 0.5 * (v + 1)) for w, b in before.items()}
    total = [sum(c.values()) for c in one]
    lam = [sum(min(n, d) for n in c.values()) / sum(c.values()) for c in one]
    p1 = lambda c, w: max(one[c][w] - d, 0) / total[c] + lam[c] * back.get(w, 1.0)
    kept = {p for p, n in two[1].items() if n > d}
    taken = [defaultdict(float), defaultdict(float)]
    for a, b in kept:
        for c in (0, 1):
            taken[c][a] += max(two[c][a, b] - d, 0)

    def p2(c, a, b):
        n = one[c][a]
        return (max(two[c][a, b] - d, 0) / n if n and (a, b) in kept else 0) + (1 - taken[c][a] / n if n else 1) * p1(c, b)

    def evidence(t):
        w = words(t)
        return [min(log(p1(1, b) / p1(0, b)), log(p2(1, a, b) / p2(0, a, b))) if a else log(p1(1, b) / p1(0, b)) for a, b in zip(["", *w], w)]

    h = common.word_hashes([w.encode() for w, _ in (one[0] + one[1]).most_common(wide)])[0]
    got = common.written(toxicity.counts(spark.createDataFrame(rows, "text string, toxic int").repartition(5), h, 7), "t")
    model = toxicity.Model.of(*toxicity.entries(got))
    texts = [t for t, _ in rows] + ["a word that nobody knows", ""]
    x, at = model.evidence([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert np.allclose(x[at[i] : at[i + 1]], evidence(t), atol=2e-5)
    got = model.features([t.encode() for t in texts], (2.0,))[:, 0]
    assert np.allclose(got, [sqrt(sum(max(e - 2, 0) for e in evidence(t)) / sqrt(max(1, len(words(t))))) for t in texts], atol=1e-4)


def test_contradicting_labels_count_as_toxic(spark):
    docs, labels = corpus(spark, 2000)
    both = labels.unionByName(labels.where("toxic = 1").selectExpr("doc_id", "quality", "0 as toxic"))
    rows = lambda m: {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    a, b = rows(toxicity.fit(docs, labels)), rows(toxicity.fit(docs, both))
    assert a == b and sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in a) > 300
