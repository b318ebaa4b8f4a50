"""Small inputs derived from the relational test tables: DataFrames and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W, H = 64, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, width: int = W, height: int = H) -> DataFrame:
    i = F.col("id")
    return spark.range(width * height).select((i % width).cast("int").alias("px"), F.floor(i / width).cast("int").alias("py"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 x 48 pixel lattice: px, py, r, g, b, depth; cells without line items have depth 0 and colour 0."""
    li = table(spark, sf_dir, "lineitem")
    cell = li.groupBy((F.col("l_partkey") % W).cast("int").alias("px"), (F.col("l_orderkey") % H).cast("int").alias("py")).agg(
        F.sum(F.col("l_linenumber").cast("long")).alias("ln"),
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("dsc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tx"),
    )
    px, py = F.col("px"), F.col("py")
    bowl = F.floor(((px - 32) * (px - 32) + (py - 24) * (py - 24)) / 4.0)
    depth = F.when(F.col("ln") % 11 == 0, 0).otherwise(800 + bowl + F.col("q") % 25)
    full = grid(spark).join(cell, ["px", "py"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return full.select("px", "py", zero(F.col("q") % 256).alias("r"), zero(F.col("dsc") % 256).alias("g"), zero(F.col("tx") % 256).alias("b"), zero(depth).alias("depth"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct small integers q, d, t of line items and real x, y, z made of them."""
    li = table(spark, sf_dir, "lineitem")
    n = li.select(F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("t")).distinct()
    return n.select("q", "d", "t", ((F.col("q") - 25) / 7.0).alias("x"), ((F.col("d") - 5) / 3.0).alias("y"), (F.col("t") / 8.0).alias("z"))


GRID_SQL = f"grid AS (SELECT CAST(i % {W} AS INT) AS px, CAST(i // {W} AS INT) AS py FROM range({W * H}) t(i))"
LATTICE_SQL = f"""{GRID_SQL},
cell AS (
  SELECT CAST(l_partkey % {W} AS INT) AS px, CAST(l_orderkey % {H} AS INT) AS py, SUM(CAST(l_linenumber AS BIGINT)) AS ln,
         SUM(CAST(l_quantity AS BIGINT)) AS q, SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS dsc, SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS tx
  FROM lineitem GROUP BY 1, 2),
pix AS (
  SELECT grid.px, grid.py, CAST(coalesce(q % 256, 0) AS INT) AS r, CAST(coalesce(dsc % 256, 0) AS INT) AS g, CAST(coalesce(tx % 256, 0) AS INT) AS b,
         CAST(coalesce(CASE WHEN ln % 11 = 0 THEN 0 ELSE 800 + FLOOR(((grid.px-32)*(grid.px-32)+(grid.py-24)*(grid.py-24))/4.0e0) + q % 25 END, 0) AS INT) AS depth
  FROM grid LEFT JOIN cell USING (px, py))"""
NUMBERS_SQL = """num AS (SELECT DISTINCT CAST(l_quantity AS INT) AS q, CAST(round(l_discount*100) AS INT) AS d, CAST(round(l_tax*100) AS INT) AS t FROM lineitem),
v AS (SELECT q, d, t, (q-25)/7.0e0 AS x, (d-5)/3.0e0 AS y, t/8.0e0 AS z FROM num)"""


def over_lattice(select: str, more: str = "") -> str:
    return f"WITH {LATTICE_SQL}{',' if more else ''}\n{more}\n{select}"


def over_numbers(select: str) -> str:
    return f"WITH {NUMBERS_SQL}\n{select}"
