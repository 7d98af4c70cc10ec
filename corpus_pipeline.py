"""A corpus pipeline of five operators: toxic documents go, one document of each group of near duplicates stays,
repeated byte strings go, contaminated documents go, and what is left is packed into sequences.

Each stage works on all rows its predecessor kept and returns the columns of documents; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import decontaminate, jaccard_join, packing, repeat_bytes, toxicity
from quillmeter.llm._store import Store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold."""
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that Jaccard links join; rows without an id stay.

    Rows of that id count as one document and all stay.
    """
    gone = jaccard_join.near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.limit(jaccard_join.BROADCAST_ROWS + 1).count() <= jaccard_join.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 200-byte strings; n_chars follows the text."""
    cut = repeat_bytes.remove_repeats(docs, keep=[c for c in docs.columns if c != "text"], with_text=True).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves; they are not changed."""
    judged = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("not contaminated").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learning, subword vocabularies and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents, each result written to the shared folder and read again."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = store.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            store.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
