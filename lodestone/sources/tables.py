"""Tables of a folder as the collections they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import uuid5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_line(c: str = "text"):
    return F.substring_index(F.col(c), "\n", 1)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content analyses: object_id, title, summary, source_tool, category, evidence_tier, created_at."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "CONFIRMED").when(F.col("toxic") == 1, "SPECULATION").when(F.col("quality") == 0, "INFERENCE")
    created = F.timestamp_seconds(F.lit(1735689600) + F.col("doc_id") * 3600)
    return docs.join(labels, "doc_id", "left").select(uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("object_id"), "doc_id", first_line().alias("title"), F.col("text").alias("summary"), F.col("source").alias("source_tool"), F.col("lang").alias("category"), tier.alias("evidence_tier"), created.alias("created_at"), "n_chars")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as session transcripts."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("object_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("turn_response"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as web search results."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("object_id"), "page_id", "url", F.col("html").alias("response"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a time that watermarks accept."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
