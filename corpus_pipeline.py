"""From raw documents to packed training sequences: each stage works on all rows that the one before it kept.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> PII -> packing. All stages but the last return the
columns of documents, whatever these are called: a row is carried as one value beside what a stage adds. The second and the third stage decide
on rows, not on doc_ids: each row of their input gets a number that is written, so rows may share a doc_id or have none. A table
without rows goes through all stages and gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, jaccard_join, packing, pii, quality
from quern.llm.support import read_table, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the raw corpus of the log-likelihood ratio is this stage's input."""
    judged = quality.judge(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return judged.where("kept").select("quern_row.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """number and row (a struct of all columns); written, as the number is another one in another run of the plan."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return stash(docs.select(F.monotonically_increasing_id().alias("number"), row), "numbered")


def _by_number(numbered: DataFrame) -> DataFrame:
    """What the operators read, with the row's number in the place of its doc_id."""
    return numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))


def _without(numbered: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows whose number isn't in the column `gone` of numbers."""
    return numbered.join(numbers, numbered["number"] == numbers["gone"], "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of smallest doc_id (null comes last), and of these the first."""
    rows = _numbered(docs)
    linked = jaccard_join.near_duplicates(_by_number(rows)).where("n_links > 0").select(F.col("doc_id").alias("gone"), "class_id")
    linked = stash(linked.join(rows.select("number", F.col("row.doc_id").alias("doc_id")), F.col("gone") == F.col("number")).drop("number"), "linked")
    firsts = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "gone"))["gone"].alias("first"))
    return _without(rows, linked.join(firsts, linked["gone"] == firsts["first"], "left_anti"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark text stands."""
    rows = _numbered(docs)
    found = decontaminate.benchmark_matches(_by_number(rows), read_table(spark, sf_dir, "benchmark"))
    return _without(rows, found.select(F.col("doc_id").alias("gone")).distinct())


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data in their text replaced by its kind; n_chars, where it is there, counts the new text."""
    redacted = pii.redact_pii(docs)
    kinds = dict(docs.dtypes)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(kinds["n_chars"]), "n_chars")) if "n_chars" in kinds else redacted


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii_redaction),
    ("packing", sequence_packing),
]

#: Hashed n-grams, MinHash, banded alignment and tokens are beyond SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
