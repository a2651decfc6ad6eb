"""From raw documents to token ids in five stages, each of one operator of ``sidelight.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``.

1. Language ID: centroids are learned from the labelled documents; documents that
   are too far from all of them, or have no letter, go.
2. Line dedup: lines of at least ten characters that several documents hold stay in
   the first alone.
3. MinHash near-dedup at a similarity of 0.8: the smallest id of each group stays.
4. Mixing: whole and fractional repetitions of documents by their source's target.
   A document that is taken twice is two rows; a fractional one has a row with its
   first words.
5. BPE: the ids of every text, checked by decoding them.

Defined results: a document with a null or empty text, or without a letter, has no
language and goes in the first stage, so later stages see none unless their input
has them; there a null text has one empty line, is near to nothing, has no words to
mix and stays once, as a null text, and has no ids. Rows with a null id are judged by
their text, lines of theirs are dropped where another document holds them, and they
are kept by near-dedup. Equal rows are one document to the third stage, and so all stay or all go.
A null source is a source. Texts of any length are read as a whole. Ties go to the
smallest id. Columns of the input beyond those of ``documents`` end in the first
stage. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelight.llm.bpe import with_tokens
from sidelight.llm.langid import fit_centroids, with_language
from sidelight.llm.line_dedup import drop_repeated_lines
from sidelight.llm.minhash import drop_near_duplicates
from sidelight.llm.mixing import mixed_rows
from sidelight.workspace import Workspace, passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKEN_MEMO = 120_000  # less than the coder's own, as executors have grown in the stages before


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs, fit_centroids(docs)).where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(drop_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, percent=80).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(mixed_rows(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return with_tokens(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], ids=True, memo=TOKEN_MEMO)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing", mixing),
    ("BPE", tokens),
]

#: Language ID and BPE are beyond SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with passing():  # what the stage wrote for itself goes with it
            done = ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        ws.drop(docs)
        docs = done
    return docs
