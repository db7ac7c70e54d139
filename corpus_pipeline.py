"""A corpus from raw documents: language ID, quality rules, near-duplicate removal, redaction of secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import langid, neardup, packing, quality, secret_scan
from heddle.llm.common import fresh, read_table, sized, written
from heddle.llm.queries import BYTE_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; a missing language is filled in."""
    names = docs.columns
    found = langid.predict(docs, langid.train(docs))
    pred = found.columns[-2]
    return found.filter(F.col(pred) != "und").withColumn("lang", F.coalesce("lang", pred)).select(names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from those of their language and source go."""
    bad = written(quality.judge(docs).filter("not kept").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct())
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(sized(bad, bad.count()), same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; rows with one id and text are one document.

    Where an id has several texts, that with the least hash is known by the id, and the others by numbers beyond all ids.
    """
    names, key, text_hash = docs.columns, fresh(docs, "doc_key"), F.xxhash64("text")
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text_hash).alias("first"), F.max(text_hash).alias("last"))
    several = written(several.filter("first != last").select(F.col("doc_id").alias("several_id"), "first"))
    n = several.count()
    if n:
        beyond = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(F.lit(1 << 62))
        docs = docs.join(sized(several, n), docs["doc_id"] == several["several_id"], "left")
        docs = written(docs.select(*names, F.when(F.xxhash64("text") != F.col("first"), beyond).otherwise(F.col("doc_id")).alias(key)))
    else:
        docs = docs.withColumn(key, F.col("doc_id"))
    found = written(neardup.near_duplicates(docs, width=5, percent=80, bins=240, id_col=key))
    gone = found.filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    out = docs.join(sized(gone, gone.count()), key, "left_anti")
    if not found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.filter(F.col(key).isNull()).unionByName(out.filter(F.col(key).isNotNull()).dropDuplicates([key]))
    return out.select(names)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark, and n_chars follows."""
    out = secret_scan.redact(docs, count="n_secrets")
    n = out.columns[-1]
    return out.withColumn("n_chars", F.when(F.col(n) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: No SQL for whole rows: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
