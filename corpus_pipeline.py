"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, nearcopies, secrets
from tidemark.llm.textkernel import Tables, held_out

#: A document is rejected if its n-grams are no likelier, on average by so many nats, under its mixture of learnt languages than spread evenly.
LEAST_GAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows of no letter (null and empty texts too), and rows that no mixture of learnt languages explains, go; mixed texts stay.

    Repeated rows and ids, and ties, are as in ``langid``: rows are judged one by one. Very long texts are read whole."""
    names, model = langid.fit(docs.filter(~F.coalesce(held_out("doc_id", 5, 0), F.lit(True))))
    kept = langid.predict(docs, names, model, docs.columns, "__")
    return kept.filter((F.col("__lang_pred") != "und") & (F.col("__gain") >= LEAST_GAIN)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup by SimHash with Golay-code keys, and bands for what these cannot reach, each pair verified to have a Jaccard
    similarity of 0.8 or more on five-word shingles: the row of smallest doc_id of each group stays."""
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of the benchmark go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: confirmed secrets are replaced in the text; the documents stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: how many words of each document the mix takes; null and empty texts take none, repeated rows and ids are rows of their own."""
    return mixing.mix(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("mix", mix)]

#: Mixture inference, component search and a random forest are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps lies in the shared checkpoint folder until the next has read it."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        now = Tables(spark)
        docs = now.table(stage(spark, docs, sf_dir))
        if kept:
            kept.drop()
        kept = now
    return docs
