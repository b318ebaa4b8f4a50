"""The pipeline against a plain version of each stage."""

import re

import numpy as np

import corpus_pipeline
from tessella.llm import jaccard, langid, toxicity
from tessella.llm.common import table


def test_pipeline_against_plain_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    limit = np.log(2) * model.trust.sum()
    near = {i for i, t in rows.items() if model.losses(langid.scaled(langid.ngram_counts([t.encode()]))).min() < limit}
    assert len(near) > 0.99 * len(rows)  # letters alone pass but for texts in no language
    rows = {i: t for i, t in rows.items() if i in near}
    kept = corpus_pipeline.language_stage(spark, docs, sf)
    assert model is not None and {r.doc_id for r in kept.collect()} == set(rows)

    tox = toxicity.fit(kept, table(spark, sf, "labels"))
    rows = {i: t for i, t in rows.items() if tox.score([t.encode()])[0] < 0.5}
    after = corpus_pipeline.toxicity_stage(spark, kept, sf)
    assert {r.doc_id for r in after.collect()} == set(rows)

    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    sets = {i: set(jaccard.gram_sets([t.encode()])[0].tolist()) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = {}
    for i in sorted(sets):
        seen = {j for g in sets[i] for j in inverted.get(g, ())}
        for j in seen:
            k = len(sets[i] & sets[j])
            if 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            inverted.setdefault(g, []).append(i)
    rows = {i: t for i, t in rows.items() if find(i) == i}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "jaccard_join", "packing"]
