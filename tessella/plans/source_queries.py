"""Generated frames, files written and read back, and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.rng import uniform_sql
from tessella.plans.cluster_queries import ONE_SQL, one_step
from tessella.plans.field_queries import DENSITY_SQL, POINT_DENSITY_SQL, cell_seeds, density
from tessella.plans.fixtures import H, W, lattice, over_lattice
from tessella.plans.graph_queries import GRAPH_SQL, region_graph
from tessella.plans.point_queries import points, points_sql
from tessella.plans.registry import query, r6, rounded
from tessella.operators.field import point_density
from tessella.scratch import scratch
from tessella.sources import frames as S
from tessella.sources import tables as T

_SUM = "count(*) AS n, sum(CAST(depth AS BIGINT)) AS depth, sum(CAST(r AS BIGINT)) AS r, sum(CAST(g AS BIGINT)) AS g, sum(CAST(b AS BIGINT)) AS b"
_FULL = "SELECT i // 307200 AS frame_id, CAST(i % 640 AS INT) AS px, CAST((i // 640) % 480 AS INT) AS py FROM range({n}) t(i)"


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("depth", "r", "g", "b")))


def _frame_sql(n: int, depth: str, r: str, g: str, b: str) -> str:
    out = _SUM.replace("sum(CAST(depth AS BIGINT)) AS depth", "CAST(sum(CAST(depth AS BIGINT)) AS BIGINT) AS depth")
    for c in "rgb":
        out = out.replace(f"sum(CAST({c} AS BIGINT)) AS {c}", f"CAST(sum(CAST({c} AS BIGINT)) AS BIGINT) AS {c}")
    return f"SELECT frame_id, {out} FROM (SELECT frame_id, {depth} AS depth, {r} AS r, {g} AS g, {b} AS b FROM ({_FULL.format(n=n * 307200)})) GROUP BY frame_id"


def _noise(c: int, tag: str) -> str:
    return f"greatest(0, least(255, {c}+CAST(floor({uniform_sql(42, chr(39) + tag + chr(39), 'frame_id', 'px', 'py')}*31) AS INT)-15))"


_WAVE = "CAST(trunc(50*sin(30.0e0*py/480)*sin(30.0e0*px/640)) AS INT)"


@query("SRC01", _frame_sql(1, f"1200+{_WAVE}", _noise(32, "r"), _noise(128, "g"), _noise(128, "b")))
def src01(spark, sf):
    return _sums(S.uniform_frame(spark, noise=True))


@query("SRC11", " UNION ALL ".join(f"SELECT '{n}' AS mode, * FROM ({q})" for n, q in (("paraboloid", _frame_sql(1, "600+((px-320)*(px-320)+(py-240)*(py-240)) // 80", "0", "128", "128")), ("uniform", _frame_sql(1, "1200", "32", "128", "128")))))
def src11(spark, sf):
    """Sources by name; any other name is refused."""
    got = [_sums(S.open_frames(spark, "test", n)).withColumn("mode", F.lit(n)) for n in ("paraboloid", "uniform")]
    return got[0].unionByName(got[1])


@query("SRC02", _frame_sql(1, "600+((px-320)*(px-320)+(py-240)*(py-240)) // 80", "0", "128", "128"))
def src02(spark, sf):
    return _sums(S.paraboloid_frame(spark))


_NEAR = "floor(sqrt((px-trunc(320+70.0e0*cos(2.0e0*3.1415e0*frame_id/100.0e0)))*(px-trunc(320+70.0e0*cos(2.0e0*3.1415e0*frame_id/100.0e0)))+(py-trunc(240+70.0e0*sin(2.0e0*3.1415e0*frame_id/100.0e0)))*(py-trunc(240+70.0e0*sin(2.0e0*3.1415e0*frame_id/100.0e0))))) < 80"


@query("SRC03", _frame_sql(4, f"CASE WHEN {_NEAR} THEN 800 ELSE 1200 END", f"CASE WHEN {_NEAR} THEN 192 ELSE 32 END", f"CASE WHEN {_NEAR} THEN 32 ELSE 128 END", f"CASE WHEN {_NEAR} THEN 32 ELSE 128 END"))
def src03(spark, sf):
    return _sums(S.sphere_frames(spark, 4))


@query("SRC04", over_lattice("SELECT px, py, greatest(0, least(255, r*2-100)) AS r, greatest(0, least(255, g-50)) AS g FROM pix"))
def src04(spark, sf):
    return lattice(spark, sf).select("px", "py", S.byte(F.col("r") * 2 - 100).alias("r"), S.byte(F.col("g") - 50).alias("g"))


def _images(spark, sf, name) -> tuple[np.ndarray, np.ndarray]:
    """The lattice as a colour and a depth image; a fixed 64 x 48 pixels."""
    p = lattice(spark, sf).toPandas().sort_values(["py", "px"])
    return p[["r", "g", "b"]].to_numpy().reshape(H, W, 3), p["depth"].to_numpy().reshape(H, W, 1)


def _put(spark, path: str, data: dict[str, bytes]) -> str:
    """Small files, written through the file system of the scratch folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, content in data.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(content))
        out.close()
    return path


_SAME = over_lattice("SELECT CAST(0 AS BIGINT) AS frame_id, px, py, r, g, b, depth FROM pix")


@query("SRC05", _SAME)
def src05(spark, sf):
    """A PNG and a 16-bit PGM, read back."""
    color, depth = _images(spark, sf, "static")
    at = _put(spark, scratch(spark, "static"), {"a_color.png": S.write_png(color), "a_depth.pgm": S.write_pnm(depth, 65535)})
    return S.read_static(spark, f"{at}/a")


@query("SRC06", over_lattice("SELECT CAST(k AS BIGINT) AS frame_id, px, py, (r+k) % 256 AS r, g, b, CAST(depth+k AS INT) AS depth FROM pix, range(3) t(k)").replace("(r+k) % 256 AS r", "CAST((r+k) % 256 AS INT) AS r"))
def src06(spark, sf):
    """A directory of depth and colour files, paired by the order of their names."""
    color, depth = _images(spark, sf, "directory")
    files = {}
    for k in range(3):
        c = color.copy()
        c[..., 0] = (c[..., 0] + k) % 256
        files[f"z{k}.pgm"] = S.write_pnm(depth + k, 65535)
        files[f"c{k}.ppm" if k else "c0.png"] = S.write_pnm(c) if k else S.write_png(c)
    return S.read_directory(spark, _put(spark, scratch(spark, "images"), files))


@query("SRC07", over_lattice("SELECT CAST(k AS BIGINT) AS frame_id, px, py, r, g, b, CAST(depth+k AS INT) AS depth FROM pix, range(2) t(k)"))
def src07(spark, sf):
    """A recording: each depth with the next colour after it; frame 0 is kept."""
    color, depth = _images(spark, sf, "record")
    files = {"d0": S.write_pnm(depth, 65535), "d1": S.write_pnm(depth + 1, 65535), "d2": S.write_pnm(depth, 65535), "r0": S.write_pnm(color), "r1": S.write_pnm(color), "INDEX.txt": b"d0\nr0\nd1\nr1\nd2\n"}
    return S.read_record(spark, _put(spark, scratch(spark, "record"), files))


@query("SRC10", "SELECT event_id AS frame_id, user_id FROM events WHERE event_id BETWEEN 10 AND 400 AND event_id % 7 = 0")
def src10(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("frame_id"), "user_id")
    return S.grab(e, 10, 400, 7)


def _density_file(spark, sf) -> str:
    at = scratch(spark, "density")
    T.write_matrix(density(spark, sf).withColumn("v", F.format_number("v", 9)), at)
    return at


@query("SRC12", over_lattice("SELECT px, py, round(v, 9) + 0.0e0 AS v FROM dens", DENSITY_SQL))
def src12(spark, sf):
    return T.read_density(spark, _density_file(spark, sf))


_TSV = over_lattice("SELECT round(x, 6) + 0.0e0 AS x, round(y, 6) + 0.0e0 AS y, round(z, 6) + 0.0e0 AS z FROM pts", points_sql())


@query("SRC13", _TSV)
def src13(spark, sf):
    at = scratch(spark, "floats")
    T.write_tsv(rounded(points(spark, sf).select("x", "y", "z")), at)
    return T.read_floats(spark, at, ["x", "y", "z"])


def _graph_folder(spark, sf) -> str:
    at = scratch(spark, "graph")
    T.write_graph(rounded(points(spark, sf).where("is_valid")), region_graph(spark, sf), at)
    return at


@query("SRC14", over_lattice("SELECT CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, " + ", ".join(f"round({c}, 6) + 0.0e0 AS {c}" for c in T.VERTEX[2:]) + " FROM pts WHERE is_valid", points_sql()))
def src14(spark, sf):
    return T.read_vertices(spark, f"{_graph_folder(spark, sf)}/vertices.tsv")


@query("SRC15", over_lattice("SELECT src, dst, weight FROM gg", GRAPH_SQL))
def src15(spark, sf):
    return T.read_edges(spark, f"{_graph_folder(spark, sf)}/edges.tsv")


@query("SRC16", over_lattice("SELECT CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y FROM pix"))
def src16(spark, sf):
    at = scratch(spark, "points")
    T.write_tsv(lattice(spark, sf).select("px", "py", "depth"), at)
    return T.read_points(spark, at)


_H = "((1-y)*cos(1.5e0*3.1415e0*(2*x-1))+y*cos(2.5e0*3.1415e0*(2*x-1)))*cos(1.5e0*3.1415e0*(2*y-1))"


@query("SRC17", f"WITH a AS (SELECT CAST(i % 128 AS INT) AS px, CAST(i // 128 AS INT) AS py, (i % 128)/127.0e0 AS x, (i // 128)/127.0e0 AS y FROM range(16384) t(i)), b AS (SELECT px, py, 0.1e0+4*(1+{_H})*(1+{_H}) AS v FROM a) SELECT px, py, round(v*(250/(SELECT sum(v) FROM b)), 9) + 0.0e0 AS v FROM b")
def src17(spark, sf):
    return rounded(T.analytic_density(spark), 9)


@query("SRC18", "SELECT CAST(i % 64 AS INT) AS px, CAST(i // 64 AS INT) AS py, 1.0e0 AS v FROM range(3072) t(i)")
def src18(spark, sf):
    return T.constant_field(spark, W, H)


@query("SRC19", over_lattice("SELECT px, py, round(r/255.0e0, 6) AS f0, round(g/255.0e0, 6) AS f1, round(b/255.0e0, 6) AS f2 FROM pix"))
def src19(spark, sf):
    return lattice(spark, sf).select("px", "py", *(r6(F.col(c) / 255.0).alias(f"f{i}") for i, c in enumerate("rgb")))


# -- sinks: written, then read back as text -----------------------------------------------------------------------------
def _lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SNK01", over_lattice("SELECT px || chr(9) || py || chr(9) || depth AS line FROM pix"))
def snk01(spark, sf):
    at = scratch(spark, "rows")
    T.write_tsv(lattice(spark, sf).select("px", "py", "depth"), at)
    return _lines(spark, at)


def _wide(names) -> str:
    return over_lattice("SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, " + ", ".join(f"round({c}, 6) + 0.0e0 AS {c}" for c in names[2:]) + " FROM pts WHERE is_valid", points_sql())


def _back(spark, path: str, names) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=", ".join(f"{n} {'int' if n in ('px', 'py') else 'double'}" for n in names))


@query("SNK02", _wide(T.VERTEX))
def snk02(spark, sf):
    at = scratch(spark, "superpixels")
    T.write_superpixels(rounded(points(spark, sf).where("is_valid")), at)
    return _back(spark, at, T.VERTEX)


@query("SNK03", over_lattice("SELECT (SELECT count(*) FROM pts WHERE is_valid) AS vertices, count(*) AS edges, round(sum(weight), 6) AS weight FROM gg", f"{points_sql()},\n{GRAPH_SQL}"))
def snk03(spark, sf):
    at = _graph_folder(spark, sf)
    v, e = T.read_vertices(spark, f"{at}/vertices.tsv"), T.read_edges(spark, f"{at}/edges.tsv")
    return v.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges"), r6(F.sum("weight")).alias("weight")))  # one row each


@query("SNK04", over_lattice("SELECT src || chr(9) || dst AS line FROM gg", GRAPH_SQL))
def snk04(spark, sf):
    at = scratch(spark, "edges")
    T.write_edges(region_graph(spark, sf), at, weights=False)
    return _lines(spark, at)


@query("SNK05", over_lattice("SELECT count(*) AS n, round(sum(v), 6) AS total FROM dens", DENSITY_SQL))
def snk05(spark, sf):
    return T.read_matrix(spark, _density_file(spark, sf)).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("total"))


@query("SNK06", _wide(T.CLUSTER))
def snk06(spark, sf):
    at = scratch(spark, "clusters")
    T.write_clusters(rounded(points(spark, sf).where("is_valid")), at)
    return _back(spark, at, T.CLUSTER)


@query("SNK07", over_lattice("SELECT py, string_agg(CAST(label AS VARCHAR), chr(9) ORDER BY px) AS line FROM lab GROUP BY py", ONE_SQL))
def snk07(spark, sf):
    at = scratch(spark, "labels")
    T.write_matrix(one_step(spark, sf)[1], at, "label")
    lines = spark.read.text(at, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("py", "line"))
    return lines.where("line != ''")


@query("SNK08", over_lattice("SELECT px, py, round(t, 6) + 0.0e0 AS target, round(v, 6) + 0.0e0 AS achieved FROM pd", f"{DENSITY_SQL},\n{POINT_DENSITY_SQL}"))
def snk08(spark, sf):
    at, d = scratch(spark, "densities"), density(spark, sf)
    both = d.withColumnRenamed("v", "target").join(point_density(cell_seeds(spark), d, W, H).withColumnRenamed("v", "achieved"), ["px", "py"])
    T.write_tsv(rounded(both), at)
    return spark.read.csv(at, sep="\t", schema="px int, py int, target double, achieved double")


@query("SNK09", over_lattice("SELECT 'area,' || CAST(CAST(count(*) AS BIGINT) AS VARCHAR) AS line FROM pix WHERE depth > 0"))
def snk09(spark, sf):
    at = scratch(spark, "metric")
    T.write_metric(spark, "area", lattice(spark, sf).where("depth > 0").agg(F.count(F.lit(1)).alias("v")), at)
    return _lines(spark, at)


@query("SNK10", over_lattice("SELECT CAST(label AS INT) AS label, count(*) AS n, CAST(sum(lab.px) AS BIGINT) AS px FROM lab JOIN pts USING (px, py) WHERE label >= 0 GROUP BY label", ONE_SQL).replace("lab.px", "px"))
def snk10(spark, sf):
    at, (pts, labels, _) = scratch(spark, "by-cluster"), one_step(spark, sf)
    T.write_by_cluster(labels, pts, at)
    return spark.read.parquet(at).groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("px"))
