"""How often the Jaccard join sends a text of a large component to be compared, and that no link is lost by it."""

import random

import pytest

from tessella.llm import jaccard


@pytest.mark.parametrize("block, most", [(7, 9), (2, 24 * 30)])
def test_large_components(spark, monkeypatch, block, most):
    """60 near copies in 9 blocks are sent to 9 units each at most; in 30 blocks, more than trees, they go by their nodes."""
    rng, texts, seen = random.Random(4), [], []
    for i in range(60):
        words = [f"w{j}" for j in range(120)]
        words[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda rows, *a: seen.append(rows.groupBy("id").count().agg({"count": "max"}).first()[0]) or verified(rows, *a))
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    got = jaccard.join(docs).collect()
    assert len(got) == 60 and {(r.n_links, r.class_id) for r in got} == {(59, 0)} and max(seen) <= most
