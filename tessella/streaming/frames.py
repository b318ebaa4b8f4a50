"""Frames as streams: one file per frame and trigger, clusters carried from frame to frame, running timings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessella.shipping import ship

ALPHA = 0.05


def frame_stream(spark: SparkSession, folder: str, schema: StructType, frames_per_trigger: int = 1) -> DataFrame:
    """A stream of frame files in a folder, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", frames_per_trigger).parquet(folder)


def pull(stream: DataFrame, path: str, most_frames: int | None = None) -> DataFrame:
    """Run all that is there now into a Parquet table under path and return it, up to a number of frames."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
    return out if most_frames is None else out.where(F.col("frame_id") < most_frames)


def seek(frames: DataFrame, first: int) -> DataFrame:
    return frames.where(F.col("frame_id") >= first)


def step(pixels: pd.DataFrame, before: list[list[float]], cells: int = 4, reach: float = 6.0) -> list[list[float]]:
    """One frame's centres (origin, x, y, v): previous centres, or a grid's, move to the mean of the pixels nearest to them in
    place and value; cells of the grid that no centre is near get a new one of origin -1."""
    xy, v = pixels[["px", "py"]].to_numpy(float), pixels["v"].to_numpy(float)
    if not len(xy):
        return [[i, *c[1:]] for i, c in enumerate(before)]
    low, size = xy.min(0), np.maximum(1.0, np.ptp(xy, axis=0) + 1)
    grid = [[-1, low[0] + size[0] * (i + 0.5) / cells, low[1] + size[1] * (j + 0.5) / cells, float(v.mean())] for j in range(cells) for i in range(cells)]
    start = [[i, *c[1:]] for i, c in enumerate(before)]
    start += [g for g in grid if all((g[1] - s[1]) ** 2 + (g[2] - s[2]) ** 2 > (reach / 2) ** 2 for s in start)]
    c = np.array([s[1:] for s in start])
    spread = max(1e-9, float(v.std()))
    d = ((xy[:, None, 0] - c[None, :, 0]) ** 2 + (xy[:, None, 1] - c[None, :, 1]) ** 2) / reach**2 + ((v[:, None] - c[None, :, 2]) / spread) ** 2
    label, out = d.argmin(1), []
    for k, s in enumerate(start):
        mine = label == k
        if mine.any():
            out.append([s[0], *xy[mine].mean(0), float(v[mine].mean())])
    return out


def incremental_clusters(stream: DataFrame, key: str = "stream_id") -> DataFrame:
    """stream: key, frame_id, px, py, v. key, frame_id, cluster_id, origin, x, y, v: the centres of each frame; origin is the index of the
    previous frame's centre they come from, or -1. The state is the last frame's centres alone."""
    ship(stream.sparkSession)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = json.loads(state.get[0]) if state.exists else []
        pixels = pd.concat(list(parts))
        rows = []
        for frame in sorted(pixels["frame_id"].unique()):
            before = step(pixels[pixels["frame_id"] == frame].sort_values(["py", "px"]), before)
            rows += [(k[0], int(frame), i, int(o), x, y, v) for i, (o, x, y, v) in enumerate(before)]
        state.update((json.dumps(before),))
        yield pd.DataFrame(rows, columns=[key, "frame_id", "cluster_id", "origin", "x", "y", "v"])

    schema = f"{key} long, frame_id long, cluster_id int, origin int, x double, y double, v double"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "centres string", "append", GroupStateTimeout.NoTimeout)


def running_stats(samples: DataFrame, tag: str, place: str, value: str, alpha: float = ALPHA, block: int = 4096) -> DataFrame:
    """tag, n, total, last, decay_mean: the exponentially weighted mean in the order of place; the first sample starts it.

    In two levels, since a mean over a block is a linear map of the mean before it: blocks of places first, then the few block
    maps of each tag, so that one tag of any size is spread over tasks."""
    rows = samples.select(F.col(tag).alias("tag"), F.col(place).alias("p"), F.col(value).cast("double").alias("t")).where("t IS NOT NULL")
    rows = rows.withColumn("b", F.floor(F.col("p") / block))
    first = rows.groupBy("tag").agg(F.min("p").alias("_first"))
    back = Window.partitionBy("tag", "b").orderBy(F.desc("p"))
    rows = rows.join(first, "tag").withColumn("k", F.row_number().over(back) - 1)
    gain = F.when(F.col("p") == F.col("_first"), 1.0).otherwise(alpha)
    part = rows.groupBy("tag", "b").agg(F.count(F.lit(1)).alias("m"), F.sum("t").alias("s"), F.max_by("t", "p").alias("l"), F.sum(gain * F.pow(F.lit(1 - alpha), F.col("k")) * F.col("t")).alias("v"))
    after = F.coalesce(F.sum("m").over(Window.partitionBy("tag").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("w", F.pow(F.lit(1 - alpha), after))
    return part.groupBy("tag").agg(F.sum("m").alias("n"), F.sum("s").alias("total"), F.max_by("l", "b").alias("last"), F.sum(F.col("v") * F.col("w")).alias("decay_mean"))
