"""Test tables in the shapes that the operators expect, and the same as SQL common tables.

events: a subject is a user, a condition an event type. embeddings: a vector is a trial's epoch of 64 samples on one
channel, its label the bin. orders: a customer's estimates by region (priority), chromophore (status) and term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, subj, condition, onset_s, amp, marker, dur_s)."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("subj"),
        F.col("event_type").alias("condition"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1000000D").alias("onset_s"),
        F.col("value").alias("amp"),
        (F.col("event_id") % 5 + 1).cast("int").alias("marker"),
        (F.col("event_id") % 3 + 1).cast("double").alias("dur_s"),
    )


E = """e AS (
  SELECT event_id, user_id AS subj, event_type AS condition, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1000000.0::DOUBLE AS onset_s,
         value AS amp, CAST(event_id % 5 + 1 AS INTEGER) AS marker, CAST(event_id % 3 + 1 AS DOUBLE) AS dur_s FROM events)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, subj, bin, idx, rel_t, value)."""
    wide = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("idx", "v"))
    return wide.select(
        F.col("vec_id").alias("trial"),
        (F.col("vec_id") % 20).alias("subj"),
        F.col("label").alias("bin"),
        "idx",
        (F.col("idx") * F.lit(0.02) - F.lit(0.2)).alias("rel_t"),
        F.col("v").cast("double").alias("value"),
    )


S = """s AS (
  SELECT trial, trial % 20 AS subj, bin, CAST(i - 1 AS INTEGER) AS idx, CAST(i - 1 AS DOUBLE) * 0.02::DOUBLE - 0.2::DOUBLE AS rel_t, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id AS trial, label AS bin, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subj, roi, chrom, beta)."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subj"), F.col("o_orderpriority").alias("roi"), F.col("o_orderstatus").alias("chrom"), (F.col("o_totalprice") / 1000.0 - 250.0).alias("beta"))


B = "b AS (SELECT o_custkey AS subj, o_orderpriority AS roi, o_orderstatus AS chrom, o_totalprice / 1000.0::DOUBLE - 250.0::DOUBLE AS beta FROM orders)"
