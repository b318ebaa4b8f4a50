"""Few links are walked by one task, with the components that the steps give."""

import random

from tessella.llm import components


def test_one_task_gives_what_the_steps_give(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3)]
    links, rounds, settled = spark.createDataFrame(links, "u long, v long"), [], components._settled
    monkeypatch.setattr(components, "_settled", lambda x: rounds.append(1) or settled(x))
    rows = lambda: sorted(map(tuple, components.components(links).collect()))
    alone = rows()
    assert not rounds
    monkeypatch.setattr(components, "ALONE", 0)
    assert alone == rows() and rounds
