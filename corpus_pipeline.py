"""From raw documents to packed training sequences.

Each stage takes what the one before kept and returns the columns of ``documents``; the
last returns the packed pieces. Every stage is stored in the shared folder before the next
one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.llm import langid, minhash, packing, substring
from salesmart.llm.queries import TOKENIZER, table
from salesmart.llm.stored import settle, settle_alone

#: SQL can't express language models, tokens or packing; tests compare the stages with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or unlike all learned languages go.

    Where nothing could be learned, all documents stay, as an empty table does. Repeated rows are
    judged alike; a null text has no letters. Very long texts are scored block by block; other
    columns, whatever their names, pass.
    """
    model = langid.fit(docs)
    if model is None:
        return docs
    told = langid.identify(docs, model)
    return told.where(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest number.

    Of rows with one number one stays; rows without a number can't be compared and stay. Null and
    empty texts resemble nothing and stay. The tables of the comparison are deleted before texts
    are shuffled. An empty table gives an empty one.
    """
    kept = settle_alone(lambda: minhash.near_duplicates(docs).where("kept").select("doc_id").distinct(), "kept")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text"))))
    left = docs.join(kept, "doc_id", "left_semi").withColumn("_first", first).where("_first = 1").select(*docs.columns)
    return left.unionAll(docs.where(F.col("doc_id").isNull()))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that start in an earlier document; those left empty go.

    Texts without such passages stay as they are, null and empty ones too, whatever their length. An
    empty table gives an empty one; other columns pass.
    """
    left = substring.remove_repeats(docs, spaced=True)
    left = left.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null text counts as empty; each repeated row has pieces of its own; long texts are cut. An
    empty table has no pieces.
    """
    return packing.pack(packing.cut(docs, TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
