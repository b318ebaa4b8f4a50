"""Properties of operators that SQL can't express, and small cases against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import color as K
from tessella.operators import cluster as C
from tessella.operators import field as O
from tessella.operators import graph as G
from tessella.operators import sampling as S
from tessella.plans import cluster_queries as Q
from tessella.plans.field_queries import density
from tessella.sources import frames as R


def test_closed_form_eigenpairs_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        a = rng.normal(size=(3, 3))
        m = a @ a.T
        rows.append([float(v) for v in (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2])])
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    s = [F.col(x) for x in "abcdef"]
    df = df.withColumns({f"l{i}": v for i, v in enumerate(C.eigenvalues(s))})
    got = df.select("*", *(v.alias(f"v{i}") for i, v in enumerate(C.eigenvector(s, F.col("l0"))))).collect()
    for r in got:
        m = np.array([[r.a, r.b, r.c], [r.b, r.d, r.e], [r.c, r.e, r.f]])
        w, v = np.linalg.eigh(m)
        assert np.allclose([r.l0, r.l1, r.l2], w, atol=1e-6)
        assert abs(abs(v[:, 0] @ [r.v0, r.v1, r.v2]) - 1) < 1e-6


def test_quadratic_fit_finds_its_surface(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(-0.1, 0.1, (50, 2))
    z = 0.2 * xy[:, 0] - 0.1 * xy[:, 1] + 3 * xy[:, 0] * xy[:, 1]
    rows = [(1, float(a), float(b), float(c)) for (a, b), c in zip(xy, z, strict=True)]
    got = C.quadratic_fit(spark.createDataFrame(rows, "k int, dx double, dy double, dz double"), ["k"]).first()
    assert np.allclose([got.s0, got.s1, got.s2, got.s3, got.s4, got.s5], [0, 0.2, -0.1, 0.03, 0, 0], atol=1e-6)


def test_pyramid_keeps_mass_and_density_its_count(spark, sf):
    d = density(spark, sf)
    total = d.agg(F.sum("v")).first()[0]
    assert abs(total - 45) < 1e-4
    for r in O.pyramid(d, 64, 48).groupBy("level").agg(F.sum("v").alias("s")).collect():
        assert abs(r.s - total) < 1e-6


@pytest.mark.parametrize("mode", ["fs", "fs_layers", "fattal", "spds", "rnd"])
def test_samplers_place_about_as_many_points_as_asked(spark, sf, mode):
    n = S.sample(mode, density(spark, sf), 64, 48).count()
    assert 25 <= n <= 65


def test_samplers_do_not_depend_on_partitions(spark, sf):
    d = density(spark, sf).persist()
    a = S.sample("spds", d.repartition(3), 64, 48).collect()
    b = S.sample("spds", d.repartition(7), 64, 48).collect()
    assert sorted(a) == sorted(b)


def test_delta_sampling_keeps_points_that_fit(spark, sf):
    from tessella.plans.field_queries import cell_seeds

    got = S.sample("dds", density(spark, sf), 64, 48, old=cell_seeds(spark)).collect()
    assert {r.origin for r in got} <= {-1, *range(48)} and sum(r.origin >= 0 for r in got) > 20
    with pytest.raises(ValueError):
        S.sample("hex", density(spark, sf), 64, 48)


def test_enclaves_leave_one_part_per_label(spark):
    rows = [(x, y, 1 if (x < 4) != ((x, y) in ((6, 2), (6, 3))) else 2) for x in range(8) for y in range(6)]
    labels = spark.createDataFrame(rows, "px int, py int, label int")
    got = {(r.px, r.py): r.label for r in C.enclaves(labels, labels).collect()}
    assert got == {(x, y): 1 if x < 4 else 2 for x in range(8) for y in range(6)}


def test_components_do_not_depend_on_edge_order(spark):
    edges = [(0, 1, 0.1), (1, 2, 0.2), (3, 4, 0.1), (4, 5, 0.9), (6, 6, 0.1)]
    v = spark.range(8).select(F.col("id").cast("int").alias("vertex"))
    for e in (edges, edges[::-1]):
        got = G.threshold_labels(v, spark.createDataFrame(e, "src int, dst int, weight double"), 0.5).collect()
        assert {r.vertex: r.label for r in got} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3, 7: 4}


def test_supervised_labels_never_merge_given_ones():
    e = pd.DataFrame({"src": [0, 1, 2], "dst": [1, 2, 3], "weight": [0.1, 0.2, 0.3]})
    assert list(G.supervised_labels(e, np.array([0, -1, -1, 1]), 1.0)) == [0, 0, 0, 1]
    segment, label = G.dynamic_supervised_labels(e, np.array([0, -1, -1, 1]), 0.05, 0.25, 0.5)
    assert list(segment) == [0, 0, 0, 3] and list(label) == [0, 0, 0, 1]


def test_spectrum_of_two_cliques(spark):
    pairs = [(a, b, 1.0) for a in range(4) for b in range(a)] + [(a + 4, b + 4, 1.0) for a in range(4) for b in range(a)] + [(0, 4, 0.01)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "src int, dst int, weight double")
    v = spark.range(8).select(F.col("id").cast("int").alias("vertex"))
    got = {(r.src, r.dst): r.weight for r in G.spectral_segments(v, edges, components=2).collect()}
    assert got[0, 4] > 10 * max(w for e, w in got.items() if e != (0, 4))


def test_images_round_trip():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (7, 5, 3))
    depth = rng.integers(0, 60000, (7, 5, 1))
    assert (R.read_png(R.write_png(rgb)) == rgb).all() and (R.read_pnm(R.write_pnm(rgb)) == rgb).all()
    assert (R.read_pnm(R.write_pnm(depth, 65535)) == depth).all()


def test_every_color_space_comes_back(spark):
    df = spark.createDataFrame([(0.2, 0.5, 0.7), (0.9, 0.1, 0.3), (0.5, 0.5, 0.5)], "a double, b double, c double")
    for space in ("RGB", "HSV", "LAB", "HN"):
        back = K.to_rgb(K.from_rgb([F.col(x) for x in "abc"], space), space)
        for r in df.select("*", *(v.alias(f"o{i}") for i, v in enumerate(back))).collect():
            assert math.dist((r.a, r.b, r.c), (r.o0, r.o1, r.o2)) < 0.02, space


def test_labels_are_contiguous_and_unique(spark, sf):
    _, labels, clusters = Q._loop(spark, sf, "rgbd", 2, conquer=True)
    rows = labels.collect()
    assert len(rows) == 3072 and len({(r.px, r.py) for r in rows}) == 3072
    assert {r.label for r in rows} - {-1} <= set(range(clusters.count()))
