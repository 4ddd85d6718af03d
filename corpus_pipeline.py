"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept and passes on rows with the columns of documents; the
last returns the packed pieces. Between stages the rows are written as Parquet and read again.
Texts without a doc_id, null texts, repeated rows and extra columns go through as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from foliant.llm import lempel_ziv, packing, quality_model, secrets, shingles
from foliant.llm._common import load, new_path, text_or_empty


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the additive model on the labels and keep what it scores at 0.5 or more."""
    model = quality_model.fit(docs, load(spark, sf_dir, "labels"))
    return docs.where(quality_model.text_scorer(model)(text_or_empty("text")) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, exact Jaccard similarity of 0.8 or more."""
    return shingles.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier in the corpus are cut out."""
    return lempel_ziv.without_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind in brackets; the documents stay."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages can't be expressed in SQL; tests/llm holds their texts against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
