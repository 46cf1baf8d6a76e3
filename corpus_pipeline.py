"""A training corpus from ``documents``: each stage takes what the one before kept.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``. Those that end in Python are written by
themselves, in small batches: whole rows wait in the executor for what Python says of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassabon.llm import language, mixing, ngram_join, pieces, pii
from kassabon.llm.common import free_name, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: null texts and texts without a letter.

    Only 'und' is rejected: the language found and its score decide nothing, ``lang`` stays as given.
    """
    name = free_name(docs, "told")
    told = language.identify(docs, docs.select("doc_id", "lang", "text"), out=name)
    return stored(told.filter(F.col(name)["lang"] != language.UNKNOWN).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group that shingle similarity links."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets for every span of personal data; ``n_chars`` follows the new text."""
    done = pii.redacted(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return stored(done.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target shares."""
    return mixing.resample(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text."""
    coded = pieces.encoded(docs.select("doc_id", "lang", "source", "text"))
    return stored(coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Stages that return what they have stored.
WRITTEN = {identify_language, redact_personal_data, encode_pieces}

#: The stages learn models and draw pseudorandom samples, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage not in WRITTEN:
            docs = stored(docs)
    return docs
