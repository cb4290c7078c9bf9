"""Select as a mergeable fold over a stream of frames.

A micro-batch is aggregated to one row a pixel and merged with the newest state of an earlier epoch, which the folder
has, into the state of its own epoch. So a batch that is run again replaces its own state, and a query that is started
again from its checkpoint goes on from what the folder has. States before the merged one are deleted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SelectFold:
    """Per pixel the samples of the greatest salience so far; ties to the earliest frame."""

    def __init__(self, spark: SparkSession, folder: str, cols: tuple[str, ...]):
        self.spark, self.folder, self.cols = spark, folder, cols

    def _path(self, epoch: int) -> str:
        return f"{self.folder}/epoch={epoch}"

    def epochs(self) -> list[int]:
        """Epochs whose state is whole, rising."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        found = sorted(int(n[6:]) for n in names if re.fullmatch(r"epoch=\d+", n))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return [e for e in found if files.exists(path(f"{self._path(e)}/_SUCCESS"))]

    def best(self, pixels: DataFrame) -> DataFrame:
        key = F.struct(F.col("s").alias("s"), (-F.col("frame_idx")).alias("f"), *self.cols)
        m = pixels.where(~F.isnan(F.col("s").cast("double"))).groupBy("y", "x").agg(F.max(key).alias("m"))
        return m.select("y", "x", F.col("m.s").alias("s"), (-F.col("m.f")).alias("frame_idx"), *[F.col(f"m.{c}").alias(c) for c in self.cols])

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``: rows of frame_idx, y, x, s and samples."""
        new = batch.select("y", "x", "s", "frame_idx", *self.cols)
        earlier = [e for e in self.epochs() if e < epoch]
        if earlier:
            new = self.spark.read.parquet(self._path(earlier[-1])).unionByName(new)
        self.best(new).write.mode("overwrite").parquet(self._path(epoch))
        for e in earlier[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(e))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self._path(self.epochs()[-1]))

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
