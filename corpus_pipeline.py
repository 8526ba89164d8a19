"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the
columns of documents, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm import decontaminate, near_copies, packing, pii, quality_classifier
from remitlens.llm.common import documents, materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier, fitted on the training labels, does not reject."""
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies (four fifths of their 5-word shingles): of the least doc_id.

    Linked SimHash fingerprints and bands of min-hashes give the pairs, whole shingle sets decide.
    """
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any window of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, personal data replaced; n_chars follows the text where it was given."""
    size = F.when(F.col("n_chars").isNotNull() & (F.col("n_replaced") > 0), F.length("text"))
    kind = docs.schema["n_chars"].dataType
    replaced = pii.replace_personal_data(docs)
    return replaced.withColumn("n_chars", F.coalesce(size.cast(kind), "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every text in sequences of 2048 tokens."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", surrogates),
    ("best_fit_packing", packed),
]

#: The classifier, near copies and the tokenizer have no SQL form; tests compare the operators with
#: brute force, near copies among them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(docs: DataFrame, stage) -> DataFrame:
        name, apply = stage
        return apply(spark, materialize(docs, name) if stage is not STAGES[0] else docs, sf_dir)

    return reduce(step, STAGES, documents(spark, sf_dir))
