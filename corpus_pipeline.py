"""The training-data pipeline over `documents`; each stage works on what its predecessor kept.

Quality: documents scored under 0.5 go. Near-duplicates: one document of each class stays. Suffix
arrays: passages of over 50 words that repeat anywhere go, the rest of a document stays.
Mixing: each document is repeated, kept or left out so that sources meet their targets. Encoding:
the texts become pieces, with a proof that decoding gives the text again.

Defined cases: a null or empty text is scored like any other and, if it stays, has no pieces; null ids
are different documents; repeated rows are near-duplicates of each other; of ties the least id stays; texts
of any length are worked on whole; columns besides those of documents go along up to the last stage; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import mixing, order_minhash, piece_fst, quality, suffix_dedup
from docloom.llm.common import Workspace
from docloom.session import table


#: A repeated passage goes from so many words on; strings of PASSAGE_BYTES are compared, which is fewer than so many words of natural text have.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 250


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(spark, docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(spark, docs, length=PASSAGE_BYTES, min_words=PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_fst.encode(docs, check=True).select("doc_id", "ids", F.size("ids").alias("n_tokens"), "exact")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("suffix_arrays", drop_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Several stages (trained scores, sketches, suffix arrays, pieces) have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
