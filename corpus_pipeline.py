"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, languages are mixed, sequences packed.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and is written as Parquet before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslake.llm.common import shipped, written
from accesslake.llm.mixing import labelled_rows, mix, resample
from accesslake.llm.packing import pack
from accesslake.llm.queries import tokenizer
from accesslake.llm.simhash import one_of_each, similar
from accesslake.llm.suffix import remove_repeats
from accesslake.llm.toxicity import keep_clean, train
from accesslake.sources.tables import Tables

#: Documents that share this percentage of their different five-word shingles are near copies.
SIMILARITY = 80
#: A repeated passage of 50 words or more has this many bytes at least.
PASSAGE = 200
#: The share of tokens each language is to have; rates are 1 at least, so no document is lost to the mix.
TARGETS = {"en": 0.55, "fr": 0.165, "de": 0.165, "es": 0.12}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from the rows of ``docs`` that have labels."""
    tables = Tables(shipped(spark), sf_dir)
    return keep_clean(docs, train(docs, tables.labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies: five-word shingles, similarity 0.8 or more.

    Rows are told apart by id and text: rows of one id but different texts are judged each for itself, of equal rows one
    stays. Null and empty texts are one class; columns may have any names; an empty table gives none.
    """
    shipped(spark)
    return one_of_each(docs, similar(docs, SIMILARITY, shingle=5))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere as well."""
    shipped(spark)
    return remove_repeats(docs, PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages' expected tokens come to ``TARGETS``.

    The classifier learns languages from documents that ``labels`` calls good, 20,000 at most.
    """
    labelled = labelled_rows(docs, Tables(shipped(spark), sf_dir).labels.where("quality = 1"), "lang")
    _, model, rates = mix(docs, labelled, TARGETS, floor=1.0)
    return resample(docs, model, rates)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, one row per piece."""
    shipped(spark)
    return pack(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifiers, the suffix arrays nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
