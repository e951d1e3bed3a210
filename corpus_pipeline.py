"""The corpus pipeline: documents in, packed training sequences out.

Each stage but the last keeps the columns of ``documents``, whatever they are named. For all stages:
a null in any column is no error, repeated rows are documents of their own unless a stage says
otherwise, an empty table gives an empty result with the stage's columns, and extra columns stay as they
are. What a stage staged is removed as soon as its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import langid, linededup, mixing, packing, simhash
from weir.llm.common import settle, stage, staged


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; texts that are in no known language go.

    Null and empty texts and texts without a letter go, and texts that cost 7.5 bits a byte or more in every language. Null
    labels teach nothing; without any label every text with a letter stays. Of equal code lengths, repeated
    rows and null doc_id nothing depends. Whole texts are scored, however long.
    """
    return langid.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents go everywhere, in the first document too.

    Null text stays null, empty text empty; blank lines stay. A key counts once a row, and rows of equal
    doc_id are documents of their own. n_chars, where there is such a column, follows the text. All
    documents stay, with an empty text if all their lines go.
    """
    return linededup.dedup_lines(docs, min_docs=10)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups keep the document of smallest id; fingerprints link at 4 or fewer bits of 64, over shingles of 4 words.

    Null and empty texts and texts without words have fingerprint zero and are one group. A null doc_id
    stays only where its group has no other; rows of equal id are told apart by the hash of their text, the
    smaller staying; of rows equal in both one stays.
    """
    return simhash.keep_one(docs, distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1; documents repeat where a source is asked for more than it has.

    A null source is a source, last in order. Null texts have no words; a source without words is kept once. The order of
    documents is random by doc_id, the same in every run; ties are broken by size and text hash, and equal rows
    share one place: they are taken alike.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: one piece of the end token alone. A long text is cut in pieces of 2048; repeated rows are packed
    each for itself, also those that the mix made. Other columns are not carried.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can express neither language ID nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's input goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = staged()
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name, narrow=False)
            settle(spark, before, docs)
    return docs
