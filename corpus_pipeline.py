"""A corpus made ready for training, stage by stage.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the last one
returns the pieces of packed sequences. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm.base import table
from tabulon.llm.decontamination import decontaminate
from tabulon.llm.ngram_join import similar_documents
from tabulon.llm.packing import pack
from tabulon.llm.secrets import redact_documents
from tabulon.llm.toxicity import learn, score_documents
from tabulon.registry.base import scratch_path
from tabulon.session import computed_once

TOXIC = 0.5
TOKENIZER = "word_bpe_49k.json"
_KEY, _GONE, _COPIES = "key of the row", "another row of its group stays", "equal rows"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below ``TOXIC``; the lexicon is learned from the labelled ones among them."""
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")), whole_rows=True)
    return scored.where(F.col("score") < TOXIC).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents: the one with the smallest id, if any has one, and of those the one
    whose columns hash lowest. Rows without words belong to no group and stay, however often they are repeated.

    Rows are told apart by id and two 64-bit hashes of all columns, not by id, which may be null or repeated. Equal
    rows share this key, so a key that stays and has copies is settled by itself.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashes = [F.xxhash64(F.lit(seed), *columns).alias(f"hash{seed}") for seed in (0, 1)]
    keyed = docs.withColumn(_KEY, F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), *hashes))
    found = similar_documents(keyed, doc_id=_KEY)
    marks = found.where(F.col("n_shingles") > 0).groupBy(F.col("doc_id").alias(_KEY)).agg(
        (F.max("component_id") != F.col("doc_id")).alias(_GONE), (F.count(F.lit(1)) > 1).alias(_COPIES)
    )
    marks = computed_once(marks.where(F.col(_GONE) | F.col(_COPIES)))
    alone = keyed.join(marks.select(_KEY), _KEY, "left_anti")
    copies = keyed.join(marks.where(~F.col(_GONE)).select(_KEY), _KEY, "left_semi").dropDuplicates([_KEY])
    return alone.unionByName(copies).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), whole_rows=True)
    return found.where(F.col("n_hit") == 0).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars`` follows the text."""
    clean = redact_documents(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
# A learned score, sets of n-grams and a tokenizer are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
