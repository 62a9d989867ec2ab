"""Toxicity, language, near copies, benchmark passages, packing: from ``documents`` to training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, jaccard, langid, packing, toxicity
from millrace.llm.store import forget, keep, sized_broadcast

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the toxicity model, trained on ``labels``, scores below its threshold."""
    settings = toxicity.Settings()
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settings)
    scored = toxicity.scored(docs.select(*COLUMNS), model, "doc_id", "text", *COLUMNS[2:])
    return scored.where(F.col("score") < settings.threshold).select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fit none of the languages that ``lang`` teaches, or have no letter."""
    found = langid.identified(docs.select(*COLUMNS), langid.train(docs), "doc_id", "text", *COLUMNS[2:])
    return found.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, 0.8) keep that of the smallest doc_id. Rows of that id stay; so do
    documents without an id or without words. Of the ids that go, a count decides whether they are broadcast."""
    groups = keep(jaccard.similarity_groups(docs, jaccard.Rule()), "groups")
    gone = keep(groups.where("doc_id != component_id").select("doc_id").distinct(), "copies")
    return docs.select(*COLUMNS).join(sized_broadcast(gone), "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of ``benchmark``."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = keep(found.select("doc_id").distinct(), "leaks")
    return docs.select(*COLUMNS).join(sized_broadcast(gone), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document that is left in sequences of 2048 tokens."""
    return packing.pack(docs, size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

#: No stage's model can be stated in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, "stage")
            forget(before)
    return docs
