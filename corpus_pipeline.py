"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; the last returns doc_id, n_tokens, ids and the text decoded from them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.bpe_automaton import bpe_round_trip
from fieldloom.llm.decontaminate import without_contaminated
from fieldloom.llm.line_dedup import keep_bitmaps, with_kept_text
from fieldloom.llm.ngram_join import ngram_components
from fieldloom.llm.toxicity import fit, without_toxic
from fieldloom.session import shared_dir, table

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return without_toxic(docs, model, TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters that 3 or more documents hold stay in the largest of these only.

    Documents stay, with the lines taken out and ``n_chars`` counted anew.
    """
    kept = with_kept_text(docs, keep_bitmaps(docs, min_chars=20, min_docs=3))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, similarity 0.8 or more) the document with the smallest id stays.

    Rows with the same id are one document; documents without words are nobody's copies.
    """
    classes = ngram_components(docs, size=5, percent=80).where("doc_id is not null")
    copies = classes.groupBy("doc_id").agg(F.min("component_id").alias("first")).where("doc_id <> first").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item (weighted similarity 0.8 or more) go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids of the byte-level vocabulary, with the text that they decode to."""
    tokens = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode_and_decode),
]

#: SQL has no compressor, SimHash or tokenizer: tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
