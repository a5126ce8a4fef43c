"""A corpus pipeline of five operators.

STAGES in order: quality rules, quality classifier, line de-duplication, near-duplicate removal, packing.  Each stage takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Models are fitted on a bounded sample of the labelled
rows of the whole ``documents`` table, since a stage's own input lacks what the stages before it rejected.

Defined cases are those of the operators; rows with a null doc_id pass the row filters by their own text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import line_dedup, packing, quality, setsketch
from quorate.llm.common import materialize, table
from quorate.llm.registry import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The pipeline as one SQL statement: none, as trained models cannot be expressed; tests compare with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True), neighbours=False)
    return quality.filter_rules(docs.select(*COLUMNS), model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.crc_fold(4) != 2, neighbours=True)
    return quality.filter_quality(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs, keep=COLUMNS)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id; rows are told apart by a number of their own, so that repeated rows, rows that
    share an id, and rows without one are documents like others."""
    rows = materialize(docs.select(*COLUMNS).withColumn("__q_row", F.monotonically_increasing_id()), "rows")
    groups = setsketch.near_duplicates(rows.select(F.col("__q_row").alias("doc_id"), "text"), setsketch.FIVE_WORDS)
    linked = rows.select("__q_row", "doc_id").join(groups.select(F.col("doc_id").alias("__q_row"), "component_id"), "__q_row")
    kept = linked.groupBy("component_id").agg(F.min_by("__q_row", F.struct(F.col("doc_id").isNull(), "doc_id", "__q_row")).alias("__q_row"))
    return rows.join(kept, "__q_row", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
