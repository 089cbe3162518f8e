"""From raw documents to a mixed training corpus: stages that each read what the one before them kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel.llm import decontaminate, mixing, near_copies, private_data, simhash, toxicity
from agropanel.llm.common import components, table, written
from agropanel.llm.training import labelled_sample


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; it learns from labels that are not held out."""
    return toxicity.keep_clean(docs, toxicity.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies the smallest id stays; rows with a null id stay too.

    Two documents are copies if their SimHash fingerprints differ in at most two bits, or if they have four fifths of all runs
    of five words in common; links of both kinds make one group.
    """
    found = simhash.groups(docs).select("doc_id", "component_id").union(near_copies.groups(docs))
    roots = components(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    gone = roots.where("node != root").select(F.col("node").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row, or a whole shorter item, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data is replaced by its kind, and n_chars is that of the new text."""
    return private_data.masked_with_size(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document that is left."""
    return mixing.taken(mixing.draws(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("private_data", without_private_data),
    ("mixing", mixed),
]

#: The trained classifier, the shingle hashes and the keyed permutation are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
