"""Toxicity scores against plain Kneser-Ney models of both classes."""

import re
from collections import Counter, defaultdict
from math import log, sqrt

import numpy as np

from tessella.llm import common, toxicity


def test_scores_equal_plain_kneser_ney_models(spark):
    """Single words go by the words before them in their class, and both classes' pairs have a probability of their own."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (common.table(spark, sf, t) for t in ("documents", "labels"))
    rows = [(r.text or "", r.toxic) for r in docs.join(labels, "doc_id").collect()]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    one, two, shared = [Counter(), Counter()], [Counter(), Counter()], defaultdict(set)
    for t, toxic in rows:
        w = words(t)
        one[toxic].update(w)
        two[toxic].update(zip(["", *w], w))
        for a, b in zip(["", *w], w):
            shared[b].add(a)
    d, types = toxicity.DISCOUNT, sum(map(len, shared.values()))
    cont = [Counter(b for _, b in c) for c in two]
    total = [c.total() for c in cont]
    lam = [sum(min(n, d) for n in c.values()) / t for c, t in zip(cont, total)]
    base = lambda w: (len(shared.get(w, ())) + 0.5) / (types + 0.5 * (len(shared) + 1))
    p1 = lambda c, w: max(cont[c][w] - d, 0) / total[c] + lam[c] * base(w)
    taken = [defaultdict(float), defaultdict(float)]
    for c in (0, 1):
        for (a, _), n in two[c].items():
            taken[c][a] += max(n - d, 0)

    def p2(c, a, b):
        n = one[c][a]
        return max(two[c][a, b] - d, 0) / n + (1 - taken[c][a] / n) * p1(c, b) if a and n else p1(c, b)

    def feature(t, margin):
        w = words(t)
        e = [min(log(p1(1, b) / p1(0, b)), log(p2(1, a, b) / p2(0, a, b))) for a, b in zip(["", *w], w)]
        return sqrt(sum(max(x - margin, 0) for x in e) / sqrt(max(1, len(w))))

    got = common.written(toxicity.counts(spark.createDataFrame(rows, "text string, toxic int").repartition(5), np.zeros(0, np.uint64), 7), "t")
    model = toxicity.Model.of(*toxicity.entries(got, continued=True))
    texts = [t for t, _ in rows] + ["a word that nobody knows", ""]
    x = model.features([t.encode() for t in texts], toxicity.MARGINS)
    for j, m in enumerate(toxicity.MARGINS):
        assert np.allclose(x[:, j], [feature(t, m) for t in texts], atol=2e-3)
