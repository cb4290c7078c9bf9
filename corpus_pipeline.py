"""A corpus from raw documents to training sequences: four stages, each a table that the next one reads.

Defined results: a null or empty text is no toxic and no near copy of another, so it is kept, mixed, and packed as its
end token; a null id is kept (its crc32 is that of the empty string, and no label is its own); a null source is a
source; repeated rows of equal id and text are near copies, of which one stays; an empty table gives no rows; further
columns pass the first three stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import mixing, ngram_join, packing, toxicity
from rasterloom.llm.shared import cut, free_name, table

#: Rows of the mix, in its order, that are packed together.
RUN_ROWS = 6_144

#: SQL has no genetic search and no sequential deadline schedule; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score below its threshold); nothing else changes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.third() != 1)
    columns, score = [F.col(f"`{c}`") for c in docs.columns], free_name(docs, "score")
    return toxicity.with_score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join, the one of the smallest id."""
    return ngram_join.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, which is the order of the written rows."""
    return mixing.in_mix_order(docs)


def in_written_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``_run``, which numbers runs of RUN_ROWS rows in the order of the files and their rows.

    ``docs`` must be a table of files, as every stage's is.
    """
    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("_file").count().collect())  # a row a file
    firsts, at = [], 0
    for name, n in counts:
        firsts.append((name, at))
        at += n
    firsts = docs.sparkSession.createDataFrame(firsts, "_file string, _first long")
    return placed.join(F.broadcast(firsts), "_file").withColumn("_run", F.floor((F.col("_first") + F.col("_index")) / RUN_ROWS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences whose documents stand near one another in the mix."""
    return packing.pack(in_written_order(docs), cell_key=F.col("_run"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
