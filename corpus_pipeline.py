"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents, further columns included, whose values and types stay as they are
whatever their names; the last returns packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import langid, minhash, mixing, packing, windows
from corvane.llm.common import WORD, materialize, scratch, set_aside, unused_name

#: A text of SHORT words or more whose best cosine is below this is in none of the languages: three standard deviations of the cosine
#: of unrelated vectors, 1 / sqrt(DIM). Shorter texts have too few trigrams to tell noise from language and stay.
LEAST_SCORE = 3 / langid.DIM**0.5
SHORT = 10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; a missing ``lang`` is filled with the prediction.

    A document goes if its text is null, empty or without letters, or has SHORT words or more and a score below LEAST_SCORE; all go if no
    document has both a label and letters. Nulls in other columns don't matter, rows that repeat are judged each, alike. Empty tables stay empty.
    """
    d, own = set_aside(docs, ["lang_pred", "score"])
    found = langid.predict_language(d, langid.fit_prototypes(d)).filter(F.col("lang_pred") != "und")
    found = found.filter((F.col("score") >= LEAST_SCORE) | (F.regexp_count("text", F.lit(WORD)) < SHORT))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Null and empty texts, and texts without words, are nobody's copies and stay, and so do rows with a null doc_id. Rows with the same doc_id are one document: they stay or go
    together, repeated rows included. Empty tables stay empty.
    """
    with scratch(spark) as keep:
        gone = unused_name(docs.columns, "_gone")
        dropped = materialize(minhash.near_duplicates(docs, percent=80).filter("not kept").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
        keep.append(dropped)
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that start earlier in the corpus are cut; texts without any stay as they are.

    What is left of a cut text has its words joined by one space, and n_chars is set to its length. Null texts stay null; a null doc_id counts as
    the smallest; rows with the same doc_id lose the same word positions and none for being equal to each other, so repeated rows stay repeated. Empty tables stay empty.
    """
    d, own = set_aside(docs, ["kept", "n_words", "n_removed"])
    d = windows.remove_repeated_windows(d)
    d = d.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*own)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them: not at all, once or twice.

    Each row is taken as often as its own plan says, also where doc_ids are null or repeat. A null source is one of its own; documents without words
    (null texts too) count no words and are taken as often as their whole source is. Empty tables stay empty.
    """
    d = mixing.mix_documents(docs, keep=True).filter("times > 0")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, cut into pieces of at most 1024 and packed into few sequences.

    A null or empty text is one piece of the end id. Rows are packed each on its own, so a document that the mix took twice, or whose
    doc_id is null or repeats, has as many sets of pieces. Empty tables give none.
    """
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: Signatures, tokenizers and knapsacks aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
