"""A training-data pipeline of the operators: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, drop, staging
from awardtrace.llm.exact_dedup import dedup
from awardtrace.llm.mixing import mixed
from awardtrace.llm.ngram_join import one_of_each
from awardtrace.llm.sampled_pieces import with_pieces
from awardtrace.llm.toxicity import not_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on the labels beside the documents."""
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts."""
    return dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles and a similarity of 0.8 reach."""
    return one_of_each(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def _free(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sampled pieces, and whether these decode to the text.

    The columns ``pieces`` and ``lossless`` get another name where documents have such columns.
    """
    lossless = F.col("decoded") == F.coalesce("row.text", F.lit(""))
    return with_pieces(docs).select("row.*", F.col("pieces").alias(_free("pieces", docs.columns)),
                                    lossless.alias(_free("lossless", docs.columns)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

# A trained classifier and sampled segmentations are beyond SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again as the next one's input.

    What a stage has written besides, and its input, is removed once its result is there.
    """
    docs = documents(spark, sf_dir)
    for number, (_, function) in enumerate(STAGES):
        with staging(spark) as scope:
            done = scope.keep(function(spark, docs, sf_dir), f"pipeline-{number}")
        drop(docs)
        docs = done
    return docs
