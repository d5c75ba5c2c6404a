"""The corpus pipeline: language ID, near-duplicate removal, decontamination,
redaction of personal data and BPE encoding, one stage after another.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of `documents`. Cases: null, empty and
letterless texts are rejected by the first stage; a document without an id can't
be named as a duplicate or as contaminated and stays; of repeated rows of an id
one stays; an empty table passes through; extra columns are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riftstats.llm import bpe, decontaminate, langid, pii, simhash
from riftstats.llm.base import checked_side, free_name, shared_dir, table

#: A document is rejected if it has no letter or if no language scores this.
LEAST_SCORE = 0.3


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and text in a column of the name returned."""
    key = free_name(docs, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = free_name(docs, "language")
    scored = langid.annotated(docs, out)
    return scored.where((F.col(f"{out}.lang_pred") != "und") & (F.col(f"{out}.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    firsts = simhash.survivors(rows, key)
    place = free_name(rows, "place")
    kept = rows.join(firsts.select(F.col("key").alias(key)), key, "left_semi")
    once = kept.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy("doc_id")))
    return once.where(F.col(place) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    hits = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return rows.join(checked_side(hits.select(F.col("doc_id").alias(key)).distinct()), key, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded, "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]

#: The stages are trained or iterative, which SQL can't express; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
