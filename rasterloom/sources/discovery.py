"""Finding stacks of frames: which files count, in which order, of which geometry."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stems of images that lie beside frames without being frames; the last is our own product.
NOT_FRAMES = ("ground_truth_all_in_focus", "depth_map", "reference_pmax", "rasterloom_fused")


def is_frame(name: str) -> Column:
    n = F.col(name)
    return n.rlike(r"(?i)\.tiff?$") & ~F.startswith(n, F.lit(".")) & ~F.regexp_replace(n, r"\.[^.]*$", "").isin(*NOT_FRAMES)


def natural_key(name: str) -> Column:
    """A string that sorts as the name does with its digit runs taken as numbers of any length."""

    def part(t: Column) -> Column:
        number = F.regexp_replace(t, r"^0+([0-9])", "$1")
        return F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number).cast("string"), 4, "0"), number)).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(0)), part), "")


def ordered(files: DataFrame, stack: str, path: str, name: str | None = None) -> DataFrame:
    """``files`` with frame_idx: natural order within the stack, ties by path."""
    order = Window.partitionBy(stack).orderBy(natural_key(name or path), path)
    return files.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("int"))


def listing(spark: SparkSession, root: str, sets: bool = False) -> DataFrame:
    """stack, path, name, frame_idx of a folder of frames, or of each folder below ``root``; files are not read."""
    pattern = f"{root}/*/*" if sets else f"{root}/*"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(pattern).select("path")
    name, stack = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    frames = files.select(F.url_decode(stack).alias("stack"), "path", F.url_decode(name).alias("name")).where(is_frame("name"))
    return ordered(frames, "stack", "path", "name")


def discover(spark: SparkSession, root: str, sets: bool = False) -> DataFrame:
    from ..plans.params import NoFrames, NoStacks

    try:
        found = listing(spark, root, sets)
        empty = found.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        empty = True
    if empty:
        raise (NoStacks if sets else NoFrames)(root)
    return found


def included(frames: DataFrame, excluded: list[int]) -> DataFrame:
    """Frames left in, numbered anew."""
    order = Window.partitionBy("stack").orderBy("frame_idx")
    kept = frames.where(~F.col("frame_idx").isin(*excluded)) if excluded else frames
    return kept.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("int"))


def check_geometry(headers: DataFrame) -> DataFrame:
    """``headers`` (stack, path, frame_idx, width, height, samples, bits) if each stack has one geometry."""
    from ..plans.params import Geometry

    shape = F.struct("width", "height", "samples", "bits")
    first = Window.partitionBy("stack").orderBy("frame_idx")
    odd = headers.withColumn("_first", F.first(shape).over(first)).withColumn("_path", F.first("path").over(first)).where(shape != F.col("_first"))
    bad = odd.orderBy("stack", "frame_idx").first()
    if bad:
        raise Geometry(f"{bad['path']} differs from {bad['_path']}")
    return headers


def ensure_outside(output: str, stack_dir: str) -> None:
    from ..plans.params import OutputInsideStack

    parent = os.path.dirname(output) or "."
    if os.path.isdir(parent) and os.path.realpath(parent) == os.path.realpath(stack_dir):
        raise OutputInsideStack(output)


def output_path(stack: str, count: int, given: str | None = None) -> str:
    """The file itself for one stack, a file in it for several; ``<stack>_fused.tif`` by default."""
    out = (given if count == 1 else os.path.join(given, f"{stack}.tif")) if given else f"{stack}_fused.tif"
    if os.path.dirname(out):
        os.makedirs(os.path.dirname(out), exist_ok=True)
    return out
