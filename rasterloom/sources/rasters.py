"""Rasters as tables of pixels: keys, y, x and samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Raster:
    """Dense pixels: each key tuple has all of 0..h-1 by 0..w-1 exactly once."""

    df: DataFrame
    keys: tuple[str, ...]
    w: int
    h: int
    cols: tuple[str, ...]

    @property
    def at(self) -> list[str]:
        return [*self.keys, "y", "x"]

    def having(self, df: DataFrame, cols: tuple[str, ...] | None = None, w: int | None = None, h: int | None = None) -> Raster:
        return replace(self, df=df, cols=cols or self.cols, w=w or self.w, h=h or self.h)

    def map(self, **exprs) -> Raster:
        return self.having(self.df.select(*self.at, *[e.alias(n) for n, e in exprs.items()]), tuple(exprs))


_OWN_DIR: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared scratch folder: what reads it has a short lineage.

    The folder is the one that spark.checkpoint.dir names; a temporary one only where that is unset.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="rasterloom-"))
        folder = _OWN_DIR[0]
    path = f"{folder}/rasters/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialised(r: Raster) -> Raster:
    return r.having(stored(r.df))


#: Vector ids that are ranked together.
RANGE = 65_536


def embedding_frames(spark: SparkSession, sf_dir: str) -> Raster:
    """Vectors as 8 x 8 frames: a stack a label, frames by vector id, samples in ten-thousandths."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("int").alias("stack"), "vec_id", "embedding")
    # Ids in ranges of RANGE: a range of a label is ranked by itself, and its first rank is the sum of those before.
    ranged = vectors.withColumn("part", F.floor(F.col("vec_id") / RANGE))
    before = Window.partitionBy("stack").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("stack", "part").agg(F.count(F.lit(1)).alias("n")).select("stack", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("stack", "part").orderBy("vec_id")) - 1
    frames = ranged.withColumn("rank", inside).join(firsts, ["stack", "part"]).select("stack", (F.col("first") + F.col("rank")).cast("int").alias("frame_idx"), "embedding")
    rows = frames.select("stack", "frame_idx", F.posexplode("embedding").alias("i", "e"))
    df = rows.select("stack", "frame_idx", F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.round(F.col("e").cast("double") * 10000).cast("long").alias("v"))
    return Raster(df, ("stack", "frame_idx"), 8, 8, ("v",))


EVENT_W, EVENT_H = 24, 30


def event_frames(spark: SparkSession, sf_dir: str) -> Raster:
    """Events by hour (x) and day (y), a frame a type: r their number, g their cents, b their users; 0 where none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = events.select("event_type").distinct()  # a handful
    frames = kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int").alias("frame_idx"))
    cells = events.where(F.dayofmonth("ts") <= EVENT_H).groupBy("event_type", (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x"))
    sums = cells.agg(F.count(F.lit(1)).alias("r"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("g"), F.countDistinct("user_id").alias("b"))
    grid = frames.select("event_type", "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(EVENT_H - 1))).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(EVENT_W - 1))).alias("x"))
    full = grid.join(sums, ["event_type", "y", "x"], "left")
    df = full.select("frame_idx", "y", "x", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("r", "g", "b")])
    return Raster(df, ("frame_idx",), EVENT_W, EVENT_H, ("r", "g", "b"))


def dyadic_transforms(spark: SparkSession, frames: int = 5) -> DataFrame:
    """frame_idx, scale, dx, dy: a similarity a frame, the identity for the middle one; a row a frame."""
    k = F.col("id") - frames // 2
    return spark.range(frames).select(F.col("id").cast("int").alias("frame_idx"), (1 + k / 64).alias("scale"), (k / 4).alias("dx"), (-k / 8).alias("dy"))
