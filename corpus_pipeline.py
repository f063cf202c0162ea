"""A corpus pipeline of five operators over the table ``documents``.

Each stage takes the session, the documents its predecessor kept and the folder of the tables, and returns a DataFrame,
which is written as Parquet and reread as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, table
from quillon.llm.jaccard import one_of_each
from quillon.llm.mixing import mix
from quillon.llm.pieces import encoded_checked
from quillon.llm.pii import personal_spans, redacted
from quillon.llm.quality import quality
from quillon.llm.registry import tokenizer


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their numbers, which no operator's own names clash with, and the name each has there."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those of null or empty text go, repeated rows share their verdict."""
    slim, names = numbered(docs)
    kept = quality(slim, slim.columns, names["text"], names["lang"], names["source"]).where("__kept")
    return kept.select(*names.values()).toDF(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more. Documents without words all stay."""
    slim, names = numbered(docs)
    return one_of_each(slim, 5, 80, names["doc_id"], names["text"]).toDF(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; a document without any is left as it is, a null text too."""
    slim, names = numbered(docs)
    text = names["text"]
    clean = personal_spans(slim, text, slim.columns, "spans")
    clean = clean.withColumn(text, redacted(F.col(text), F.col("spans")))
    if size := names.get("n_chars"):
        clean = clean.withColumn(size, F.when(F.size("spans") > 0, F.length(text).cast(slim.schema[size].dataType)).otherwise(F.col(size)))
    return clean.select(*names.values()).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those of null or empty text aren't taken."""
    slim, names = numbered(docs)
    return mix(slim, names["text"], names["doc_id"], names["source"]).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, checked by decoding them; a null text counts as empty."""
    return encoded_checked(docs, tokenizer("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("pii", redact), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The stages hold a similarity join, trees and a merge-type encoding, which SQL can't express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
