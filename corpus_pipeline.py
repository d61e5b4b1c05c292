"""A corpus pipeline of five stages over ``documents``: each takes what the one before kept.

Reject toxic documents, drop exact copies, keep one document of each near-duplicate group, cut
passages that earlier documents hold, and pack what is left into token sequences. All stages
but the last return the columns of ``documents``. Texts of any length are handled whole, other
columns may have any name, and empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import bpe, chunk_dedup, exact_dedup, jaccard, packing, toxicity
from offerloom.llm.common import release_shuffles, staged, unused
from offerloom.llm.language import remainder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half. The model learns from labelled rows
    outside the held-out fold. Null and empty texts score by the model's offset alone; rows with a
    null doc_id are judged like others; repeated rows go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels.where(remainder(5) != 0)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original stays, then the smallest
    doc_id, then one of repeated rows. Null counts as empty, so one empty text stays."""
    return exact_dedup.keep_first(docs, exact_dedup.fresh_index(spark), written=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, over any
    number of links, the one with the smallest doc_id stays. Rows with a null doc_id, or whose
    text has no word, link with nothing and stay."""
    groups = jaccard.join(docs, jaccard.Measure(words=5, part=80, of=100))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id holds are cut; n_chars follows. Null texts
    stay null; rows with a null doc_id stay whole."""
    report = unused(docs, "report")[0]
    left = chunk_dedup.dedup(docs, grow=True, report=report).drop(report)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 2048 tokens; null texts count as
    empty and give one piece with the end id."""
    return packing.pack(packing.pieces(docs, bpe.default_vocabulary()))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: No SQL can express the classifier, the chunks or the tokens; tests hold stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
