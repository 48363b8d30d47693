"""Documents to a training mix: quality, near duplicates, benchmark leaks, personal data, sources.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents, in their order. Stages are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm import decontaminate, jaccard_join, mixing, pii, quality_mil
from blockmill.llm.common import Scratch, table
from blockmill.llm.queries import BLOCK_CHARS
from blockmill.scratch import scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. It is fitted on labelled documents of this stage's input.

    Every row is judged by its text alone: null and empty texts as texts of one empty passage, repeated rows alike, null
    ids like others. An empty table stays empty; without labels every score is 0.5, so that all rows go. Other columns
    pass through, whatever their names.
    """
    return quality_mil.keep_good(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id; of repeated rows of an id, one.

    Rows that repeat an id with another text are documents of their own: what is no copy stays. Documents without words
    (null, empty and blank texts), or without an id, are in no group and stay, repeated ones too. An empty table stays
    empty. Other columns pass through, whatever their names; of linked rows those of the row that stays.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # rows in place of ids: numbers in the order of the ids, written so that they hold
        whole = docs.where("doc_id IS NOT NULL").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
        whole = whole.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).select(F.monotonically_increasing_id().alias("number"), "row", "text")
        whole = Scratch(spark, "numbered").write(whole, "rows")
        gone = _copies(whole.select(F.col("number").alias("doc_id"), "text")).withColumnRenamed("doc_id", "number")
        kept = whole.join(gone, "number", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
        return kept.unionByName(docs.where("doc_id IS NULL"))
    return docs.join(_copies(docs), "doc_id", "left_anti").select(*docs.columns)


def _copies(docs: DataFrame) -> DataFrame:
    """Ids of documents that are linked with one of a smaller id."""
    found = jaccard_join.jaccard_components(docs, size=5, percent=80)
    return found.where("doc_id IS NOT NULL AND n_shingles > 0 AND component_id <> doc_id").select("doc_id").distinct()


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark.

    Every row is judged by its text alone: null and empty texts stay, repeated rows go or stay together, null ids are like
    others. An empty table, or an empty benchmark, drops nothing. Other columns pass through, whatever their names.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of its kinds; n_chars follows the text.

    Null texts stay null (and so is their n_chars), empty ones empty; repeated rows, null ids and all other columns stay,
    whatever their names, and no row goes. An empty table stays empty.
    """
    out = pii.redact_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: every document, its text and other columns, and its place (block, at, slot, on_target).

    Training reads by slot, then at. n_chars is the text's length, null texts having none; a null source is the source ''.
    Repeated rows and null ids keep a row each. An empty table gives no rows. Columns of the documents that are named as
    one of the place's own are replaced by it.
    """
    return mixing.mix(docs, block_chars=BLOCK_CHARS, carry=docs.columns)


STAGES = [
    ("7 quality classifier", quality),
    ("2 n-gram Jaccard join", near_duplicates),
    ("9 benchmark decontamination", benchmark_leaks),
    ("6 PII", personal_data),
    ("3 mixing sources", sources),
]

#: The classifier and the decontamination have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with scope():  # what a stage keeps on its way goes when its result is written
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
