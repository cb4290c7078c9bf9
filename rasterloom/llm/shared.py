"""Helpers that several operators of this subpackage use: lineage cuts, salted ranks, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: Bits of a digest that order rows.
HASH_BITS = 60


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and Spark is one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="rasterloom-"))
    return _OWN_DIR[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    What is read later depends on files that every executor sees, not on the lineage, so that a lost
    executor costs no recomputation and two readers see the same rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written by :func:`cut`: when no result is still to be read."""
    _delete(spark, f"{scratch_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}")


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leading_bits(digest: Column) -> Column:
    """The first ``HASH_BITS`` bits of a hex digest as a non-negative long; 0 for null."""
    return F.coalesce(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"), F.lit(0))


def salted_rank(df: DataFrame, keys: list[str], salt: Column, order: list[Column], out: str, salts: int) -> DataFrame:
    """Add ``out``, the gapless rank from 0 of each row inside its key, without bringing a key together.

    Rows of a key are ranked inside ``salts`` salted parts; the parts' counts, at most ``salts`` a key, give
    each part its first rank. ``salt`` must be a non-negative number below ``salts`` that depends on the
    row's content alone. Rows that tie in ``order`` take their ranks in any order.
    """
    salted = df.withColumn("_salt", salt.cast("int"))
    part = [*keys, "_salt"]
    counts = salted.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*part).orderBy(*order)
    ranked = salted.withColumn("_rn", F.row_number().over(inside) - 1)
    return ranked.join(starts, part).withColumn(out, F.col("_first") + F.col("_rn")).drop("_salt", "_first", "_rn")
