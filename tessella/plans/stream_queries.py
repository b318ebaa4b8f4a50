"""Streams, user-defined functions and the remaining cluster operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import metric as D
from tessella.operators import cluster as C
from tessella.plans.cluster_queries import COVERAGE, FW, NAMES, ONE_SQL, RHO, feature_height, feature_points, feature_seeds, generic_sql, labelled, loop_sql, one_step, points, seeds
from tessella.plans.fixtures import H, W, lattice, over_lattice, table
from tessella.plans.registry import query, r6, rounded
from tessella.scratch import scratch
from tessella.streaming import frames as S


def event_frames(spark, sf) -> DataFrame:
    """Days of events as frames of 16 users by 24 hours."""
    e = table(spark, sf, "events").select(F.dayofmonth("ts").cast("long").alias("frame_id"), (F.col("user_id") % 16).cast("int").alias("px"), F.hour("ts").alias("py"), "value")
    return e.groupBy("frame_id", "px", "py").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("v"))


FRAMES_SQL = "SELECT CAST(day(ts) AS BIGINT) AS frame_id, CAST(user_id % 16 AS INT) AS px, CAST(hour(ts) AS INT) AS py, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY 1, 2, 3"


def _streamed(spark, sf) -> tuple[DataFrame, str]:
    folder = scratch(spark, "frames")
    rows = event_frames(spark, sf).withColumns({"stream_id": F.lit(0).cast("long"), "day": F.col("frame_id")})
    rows.coalesce(1).sortWithinPartitions("day").write.partitionBy("day").parquet(folder)  # at most 31 small frames, written in order
    return S.frame_stream(spark, folder, spark.read.parquet(folder).schema), scratch(spark, "stream")


@query("ST01", f"SELECT frame_id, count(*) AS n_pixels, round(sum(v), 4) AS v FROM ({FRAMES_SQL}) WHERE frame_id < 20 GROUP BY frame_id")
def st01(spark, sf):
    """All frames there are, pulled one file a trigger, up to a limit."""
    stream, at = _streamed(spark, sf)
    got = S.pull(stream, at, most_frames=20)
    return got.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.sum("v"), 4).alias("v"))


def _carried(spark, sf) -> DataFrame:
    stream, at = _streamed(spark, sf)
    return S.pull(S.incremental_clusters(stream.select("stream_id", "frame_id", "px", "py", "v")), at)


@query("ST02")
def st02(spark, sf):
    """Centres of every frame, started from those of the frame before."""
    return rounded(_carried(spark, sf))


@query("ST03")
def st03(spark, sf):
    """How many centres of a frame come from the frame before."""
    return _carried(spark, sf).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") >= 0).alias("carried"))


@query(
    "ST04",
    "WITH e AS (SELECT event_type AS tag, value AS t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS k FROM events WHERE value IS NOT NULL) "
    "SELECT tag, CAST(count(*) AS BIGINT) AS n, round(sum(t), 4) AS total, round(arg_max(t, event_id), 4) AS last, round(sum(CASE WHEN i = 1 THEN 1.0e0 ELSE 0.05e0 END*pow(0.95e0, k)*t), 4) AS decay_mean FROM e GROUP BY tag",
)
def st04(spark, sf):
    return rounded(S.running_stats(table(spark, sf, "events"), "event_type", "event_id", "value"), 4)


@query("ST05", f"SELECT * FROM ({FRAMES_SQL}) WHERE frame_id >= 25")
def st05(spark, sf):
    return S.seek(event_frames(spark, sf), 25)


# -- remaining cluster operators ----------------------------------------------------------------------------------------
@query("C08")
def c08(spark, sf):
    """Parts cut off from their label go to the neighbour around them."""
    pts, labels, _ = one_step(spark, sf)
    return C.enclaves(labels, pts)


def _solve_sql() -> str:
    """Gauss-Jordan steps over the 6 x 6 moments of every cluster, no pivoting (they are positive definite)."""
    terms = ["1.0e0", "dx", "dy", "dx*dy", "dx*dx", "dy*dy"]
    first = [f"sum(({terms[i]})*({terms[j]})) AS a{i}{j}" for i in range(6) for j in range(6)] + [f"sum(({terms[i]})*dz) AS r{i}" for i in range(6)]
    out = ["mc AS (SELECT label AS l, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM lab JOIN pts USING (px, py) WHERE label >= 0 GROUP BY label)"]
    out += ["mo AS (SELECT label, (x-mx)*100 AS dx, (y-my)*100 AS dy, (z-mz)*100 AS dz FROM lab JOIN pts USING (px, py) JOIN mc ON l = label)"]
    out += [f"z0 AS (SELECT label, {', '.join(first)} FROM mo GROUP BY label)"]
    for k in range(6):
        rows = [f"{f'a{i}{j}' if i == k else f'a{i}{j}-a{i}{k}*a{k}{j}/a{k}{k}'} AS a{i}{j}" for i in range(6) for j in range(6)]
        rows += [f"{f'r{i}' if i == k else f'r{i}-a{i}{k}*r{k}/a{k}{k}'} AS r{i}" for i in range(6)]
        out.append(f"z{k + 1} AS (SELECT label, {', '.join(rows)} FROM z{k})")
    return ",\n".join(out)


@query("C11", over_lattice("SELECT CAST(label AS INT) AS label, " + ", ".join(f"round(r{i}/a{i}{i}, 3) + 0.0e0 AS s{i}" for i in range(6)) + " FROM z6", f"{ONE_SQL},\n{_solve_sql()}"))
def c11(spark, sf):
    """Quadratic surfaces through clusters (numpy agrees in the tests)."""
    rows = labelled(spark, sf)
    centre = rows.groupBy("label").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    off = rows.join(centre, "label").select("label", *((F.col(c) - F.col(f"m{c}")).alias(f"d{c}") for c in "xyz"))
    return rounded(C.quadratic_fit(off, ["label"]), 3)


# -- user-defined parts -------------------------------------------------------------------------------------------------
_MANHATTAN = "(abs(p.px-c.px)+abs(p.py-c.py)+5.0e0*abs(p.c0-c.c0))"


@query("U01", over_lattice(f"SELECT p.px, p.py, cluster_id AS label FROM pts p JOIN cl0 c ON is_valid AND abs(p.px-c.px) <= greatest(2, CAST(trunc(c.radius_px*{COVERAGE}e0+0.5e0) AS INT)) AND abs(p.py-c.py) <= greatest(2, CAST(trunc(c.radius_px*{COVERAGE}e0+0.5e0) AS INT)) QUALIFY row_number() OVER (PARTITION BY p.px, p.py ORDER BY {_MANHATTAN}, cluster_id) = 1", loop_sql(1, "rgb")))
def u01(spark, sf):
    """Assignment by a metric of the caller: any function of two points' columns."""
    pts = points(spark, sf)
    cl = C.create_clusters(seeds(spark, pts), pts, W, H, mode="rgb")

    def manhattan(p: D.Point, q: D.Point):
        return F.abs(p["px"] - q["px"]) + F.abs(p["py"] - q["py"]) + 5.0 * F.abs(p["c0"] - q["c0"])

    return C.assign(cl, pts, manhattan, COVERAGE, W, H).select("px", "py", "label")


@query("U02", over_lattice("SELECT CAST(label AS INT) AS label, round(median(c0), 6) AS c0 FROM lab JOIN pts USING (px, py) WHERE label >= 0 GROUP BY label", ONE_SQL))
def u02(spark, sf):
    """A mean of the caller's, as a grouped-aggregate function over Arrow batches."""

    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())

    return labelled(spark, sf).groupBy("label").agg(r6(middle("c0")).alias("c0"))


@query("U03", generic_sql(1) + "SELECT px, py, label FROM h0")
def u03(spark, sf):
    """Features are any columns, given by name."""
    f, h = feature_points(spark, sf), feature_height(spark, sf)
    return C.assign_generic(C.local_mean(feature_seeds(spark, h), f, list(NAMES), FW, h, rho=RHO), f, C.euclid(list(NAMES)), 3.0, 1.0, FW, h, list(NAMES), rho=RHO)


@query("U04", over_lattice("SELECT label, count(*) AS n, round(sum(abs(c0-m)), 6) AS spread FROM (SELECT label, c0, avg(c0) OVER (PARTITION BY label) AS m FROM lab JOIN pts USING (px, py) WHERE label >= 0) GROUP BY label", ONE_SQL))
def u04(spark, sf):
    """A visitor of every cluster with its pixels."""
    rows = labelled(spark, sf).select("label", "c0")

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "n": [len(pdf)], "spread": [(pdf["c0"] - pdf["c0"].mean()).abs().sum()]})

    return rounded(rows.groupBy("label").applyInPandas(visit, "label int, n long, spread double"))


@query("U08", "SELECT CAST(i % 16 AS INT) AS px, CAST(i // 16 AS INT) AS py FROM range(192) t(i)")
def u08(spark, sf):
    """A grid from a table function."""
    from pyspark.sql.functions import lit, udtf

    @udtf(returnType="px: int, py: int")
    class Box:
        def eval(self, width: int, height: int):
            for y in range(height):
                for x in range(width):
                    yield x, y

    return Box(lit(16), lit(12))


