"""Small component tables are walked by one task: no lookups, and the components that the steps give."""

import random

from tessella.llm import common, components, jaccard


def test_few_ties_grow_components_in_one_task(spark, monkeypatch):
    rng = random.Random(3)
    draw = lambda most, n: spark.createDataFrame([(rng.randrange(most), rng.randrange(most)) for _ in range(n)], "u long, v long").where("u != v")
    first, more, asked, lookup = draw(90, 30), draw(120, 25), [], common.lookup
    for module in (common, components):
        monkeypatch.setattr(module, "lookup", lambda *a: asked.append(1) or lookup(*a))

    def grown():
        before = jaccard._grow(None, first, 1000)
        after = jaccard._grow(before.select("node", "root"), more, 1000)
        return [sorted(map(tuple, x.select("node", "root", "grown").collect())) for x in (before, after)]

    alone = grown()
    assert not asked and {g for _, _, g in alone[1]} == {True, False}
    monkeypatch.setattr(components, "ALONE", 0)
    assert alone == grown() and asked


def test_few_entries_are_looked_up_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(300)], "k long, x long")
    entries = spark.createDataFrame([(i, 10 * i, 43) for i in range(5)], "k long, y long, n long")
    got, plain = common.lookup(rows, ["k"], entries, "n", 300, 5), common.lookup(rows, ["k"], entries, "n", 300)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
