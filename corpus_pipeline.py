"""The corpus pipeline: reject toxic documents, drop copies and near copies, mix sources, encode.

Each stage gets all documents that its predecessor kept and returns those it keeps, with the columns
of ``documents``; the last returns their ids. Defined results are those of the operators; of rows
equal in id and text one passes the second, third and fourth stages (the mix then repeats documents
as its quotas say).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickertide.llm import exact_dedup, mixing, near_dups, pieces_coding, toxicity
from tickertide.llm.common import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal without blanks."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word grams, similarity 0.8)."""
    return near_dups.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them."""
    return mixing.whole_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document of the mix."""
    import public_tokenizers

    model = pieces_coding.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces_coding.encode(docs, model, columns=["doc_id", "source"])


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

# The classifier, the iterated classes and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
