"""A corpus pipeline of five stages over ``documents``; see ``STAGES``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and is the
next stage's docs. All but the last keep the columns of documents. Rows with a null id stay where their
text passes; empty tables pass through; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeflow.llm import mixing, near_dedup, quality_classifier, quality_rules, sentence_pieces
from scribeflow.llm.common import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_quality(docs, _labels(spark, sf_dir))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under one half go."""
    labels = quality_classifier.learnable(_labels(spark, sf_dir))
    return quality_classifier.keep_scored(docs, quality_classifier.train_classifier(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest id, then text class, then row.

    Texts without words are in no group and stay.
    """
    found = near_dedup.near_duplicates(docs, classes_too=True).where("cls is not null")
    rows = found.groupBy("root", "doc_id", "cls").agg(F.count("*").alias("copies"))
    pick = F.min_by(F.struct("doc_id", "cls", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "cls"))
    stays = Scratch(spark, "kept").write(rows.groupBy("root").agg(pick.alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.cls").alias("kept_cls"), F.col("x.copies").alias("copies")), "ids")
    known = stays.agg(F.count("*").alias("n"), F.max("copies").alias("most")).first()
    ids = stays.select("kept_id", "kept_cls")
    if known["n"] <= near_dedup.BROADCAST_IDS:
        ids = F.broadcast(ids)
    classed = near_dedup.with_class(docs)
    out = classed.where("cls is not null").join(ids, (F.col("cls") == F.col("kept_cls")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    if (known["most"] or 0) > 1:  # rows alike in id and words keep one
        out = out.groupBy("doc_id", "cls").agg(F.min("row").alias("row"))
    return out.select("row.*").unionByName(classed.where("cls is null").select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them."""
    mixed, _ = mixing.mix_sources(docs, F.array("source"), mixing.n_words(F.col("text")))
    return mixed.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), "repeats"))).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with digests of the ids and of the decoded text."""
    return sentence_pieces.tokenize_documents(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Fitted models, a flow and a vocabulary decide the rows, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
