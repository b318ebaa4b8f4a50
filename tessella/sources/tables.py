"""Text tables: densities, points, graphs, labels and clusters as tab-separated values, in and out."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.frames import decode_image

VERTEX = ("px", "py", "x", "y", "z", "c0", "c1", "c2", "nx", "ny", "nz")
CLUSTER = ("px", "py", "c0", "c1", "c2", "x", "y", "z", "nx", "ny", "nz")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """px, py, v of a whitespace matrix: a line is a row of the image. Lines are numbered in one file, read as a whole."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("py", "line"))
    cells = lines.select("py", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("px", "v"))
    return cells.where("v != ''").select("px", "py", F.col("v").cast("double").alias("v"))


def read_density(spark: SparkSession, path: str) -> DataFrame:
    """A matrix, or an image whose mean channel is divided by 255."""
    if path.lower().endswith((".png", ".pgm", ".ppm")):
        data = spark.read.format("binaryFile").load(path).select("content").first()[0]  # one image
        pixels = decode_image(bytes(data)).mean(2) / 255.0
        rows = [(x, y, float(v)) for y, line in enumerate(pixels) for x, v in enumerate(line)]
        return spark.createDataFrame(rows, "px int, py int, v double")
    return read_matrix(spark, path)


def read_floats(spark: SparkSession, path: str, names: list[str], separator: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=separator, schema=", ".join(f"{n} double" for n in names), mode="FAILFAST")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The first two numbers of each line."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y"))


def _fields(low: int, high: int) -> Column:
    n = F.size(F.split(F.trim("value"), r"\s+"))
    return F.when(n.between(low, high), F.split(F.trim("value"), r"\s+")).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))))


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Exactly eleven fields a line, else an error. The vertex number is the first column of what write_graph writes beside."""
    p = spark.read.text(path).where(F.trim("value") != "").select(_fields(11, 11).alias("p"))
    return p.select(*(F.col("p")[i].cast("double").alias(n) for i, n in enumerate(VERTEX)))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Two or three fields a line; the weight is 1 by default. Every edge is read once."""
    p = spark.read.text(path).where(F.trim("value") != "").select(_fields(2, 3).alias("p"))
    return p.select(F.col("p")[0].cast("int").alias("src"), F.col("p")[1].cast("int").alias("dst"), F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))


def write_tsv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Rows as tab-separated values, doubles with so many significant digits."""
    cols = [F.format_string(f"%.{digits}g", c).alias(c) if digits and t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, sep="\t", mode="overwrite")


def write_superpixels(points: DataFrame, path: str) -> None:
    """Position before colour, as graph vertices."""
    write_tsv(points.select(*VERTEX), path)


def write_clusters(points: DataFrame, path: str) -> None:
    """Colour before position."""
    write_tsv(points.select(*CLUSTER), path)


def write_graph(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    write_tsv(vertices.select(*VERTEX), f"{folder}/vertices.tsv")
    write_tsv(edges.select("src", "dst", "weight"), f"{folder}/edges.tsv")


def write_edges(edges: DataFrame, path: str, weights: bool = True) -> None:
    write_tsv(edges.select("src", "dst", *(["weight"] if weights else [])), path)


def matrix_lines(field: DataFrame, value: str = "v") -> DataFrame:
    """py, line: every row of the image as one line."""
    return field.groupBy("py").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("px", value))), lambda c: c[value].cast("string")), "\t").alias("line"))


def write_matrix(field: DataFrame, path: str, value: str = "v") -> None:
    """Lines in the order of rows, in one file as the format asks; a line per image row."""
    matrix_lines(field, value).coalesce(1).sortWithinPartitions("py").select("line").write.text(path)


def write_metric(spark: SparkSession, name: str, value: DataFrame, path: str) -> None:
    """`name,value` of a one-row result."""
    value.select(F.concat(F.lit(f"{name},"), F.col(value.columns[0]).cast("string")).alias("line")).coalesce(1).write.text(path)


def write_by_cluster(labels: DataFrame, pixels: DataFrame, path: str) -> None:
    """Pixels of every cluster in a folder of its own."""
    labels.where("label >= 0").join(pixels, ["px", "py"]).write.partitionBy("label").parquet(path)


def analytic_density(spark: SparkSession, size: int = 128, num: int = 250) -> DataFrame:
    """An analytic density, scaled to num points."""
    i, pi = F.col("id"), 3.1415  # fixed value: the constant of the results to match
    x, y = (i % size) / (size - 1), F.floor(i / size) / (size - 1)
    u, v = 2 * x - 1, 2 * y - 1
    h = ((1 - y) * F.cos(1.5 * pi * u) + y * F.cos(2.5 * pi * u)) * F.cos(1.5 * pi * v)
    rows = spark.range(size * size).select((i % size).cast("int").alias("px"), F.floor(i / size).cast("int").alias("py"), (0.1 + 4 * (1 + h) * (1 + h)).alias("v"))
    total = rows.agg((float(num) / F.sum("v")).alias("_s"))
    return rows.crossJoin(F.broadcast(total)).select("px", "py", (F.col("v") * F.col("_s")).alias("v"))  # one row


def constant_field(spark: SparkSession, width: int, height: int, value: float = 1.0) -> DataFrame:
    i = F.col("id")
    return spark.range(width * height).select((i % width).cast("int").alias("px"), F.floor(i / width).cast("int").alias("py"), F.lit(value).alias("v"))


