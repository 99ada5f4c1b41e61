"""Corpus pipeline: toxicity, quality, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the last return the
columns of documents; a row keeps its values. Null and empty texts pass the first four stages as their operators define:
they have the model's base chance, zero statistics, no shingle and no words. Rows repeated under one doc_id stand
or fall together, except that near-duplicate removal keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.llm.common import free_name, table, written
from voxframe.llm.decontamination import find_benchmark
from voxframe.llm.jaccard import near_duplicates
from voxframe.llm.packing import pack_documents
from voxframe.llm.quality import fit_quality, score_quality, training_labels
from voxframe.llm.toxicity import fit_toxicity, score_toxicity


def _kept(docs: DataFrame, score, made: tuple[str, ...], keep: str) -> DataFrame:
    """docs where `keep` holds for score(docs), which adds the columns `made`; own columns of these names come back as they were."""
    aside: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in made:
            aside[c] = free_name([*docs.columns, *made, *aside.values()], f"own_{c}")
    scored = score(docs.select(*[F.col(c).alias(aside.get(c, c)) for c in docs.columns]))
    return scored.where(keep).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (fitted on the labelled ones among docs) doesn't call toxic."""
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    return _kept(docs, lambda df: score_toxicity(df, model), ("toxic_score", "toxic_predicted"), "toxic_predicted = 0")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model (fitted on the labelled ones among docs) calls good."""
    forest = fit_quality(docs, training_labels(table(spark, sf_dir, "labels"), "quality", 4, 2))
    return _kept(docs, lambda df: score_quality(df, forest, cut=0.7), ("quality_score", "quality_predicted"), "quality_predicted = 1")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near duplicates, once; texts without an id stay, one of each."""
    found = near_duplicates(docs)
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    first = docs.join(heads, docs["doc_id"].eqNullSafe(heads["doc_id"]), "left_semi")
    line = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[c for c in docs.columns if c != "doc_id"]))
    copy = free_name(docs.columns, "copy")
    return first.withColumn(copy, F.row_number().over(line)).where(F.col(copy) == 1).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    hit = find_benchmark(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The learned stages and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
