"""The training-data pipeline over `documents`: language ID, exact and near deduplication, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import language_id
from tallybook.llm.exact_dedup import drop_exact_copies
from tallybook.llm.minhash import drop_near_copies
from tallybook.llm.packing import pack_documents
from tallybook.llm.secret_scan import redact_secrets


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; lang becomes the predicted one.

    The models are fitted on the labelled documents of this stage's input. A document goes if it has no letter, so that
    null and empty texts go, or if its text is far from what its best language's texts look like. Documents are judged
    one by one: repeated rows, ties and null ids need no care. All columns stay under their names, whatever those are;
    they go through the model under numbers, as it has columns of its own. An empty table stays empty; without labelled
    documents there is no language, and none is kept.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    known = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    found = language_id.identify(docs.toDF(*names), language_id.fit(docs), known["text"]).where("not rejected")
    return found.select(*(F.col("lang_pred" if n == known.get("lang") else n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: of several ids the smallest, of repeated rows one.

    Null and empty texts are equal to each other; of rows of null id one stays where their text has no row with an id.
    All columns stay. An empty table stays empty.
    """
    return drop_exact_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    Texts without words, null ones among them, and rows of null id stay. Rows that repeat an id share its fate. All
    columns stay. An empty table stays empty.
    """
    return drop_near_copies(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets, and weak ones that complementary parts confirm, masked in the text.

    Null texts have no secrets. Documents are judged one by one: repeated rows, ties and null ids need no care. All columns
    stay. An empty table stays empty.
    """
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null or empty text has one piece, of the closing token. Repeated rows and null ids are packed like any others; other
    columns stay behind. An empty table gives no pieces.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_similar),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Language models and token packing have no SQL form; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' functions applied to `documents`, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
