"""The driver tables seen as the library's entities, in Spark and as SQL for the oracle.

events: a row is an event; the user is the recording, seconds since 2024 are the offset, value is the duration,
event_type is the behaviour ('error' is the minority 'tail', 'view' is 'other', the rest is 'ear').
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of 2024-01-01.
EPOCH = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("event_idx"),
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video"),
        F.expr("cast(user_id % 6 as int)").alias("grp"),
        F.expr("cast(user_id % 4 as int)").alias("camera"),
        F.expr("CASE event_type WHEN 'error' THEN 'tail' WHEN 'view' THEN 'other' ELSE 'ear' END").alias("behavior"),
        "event_type",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D").alias("start_sec"),
        F.col("value").alias("duration_sec"),
        F.get_json_object("props", "$.k").alias("animal_id"),
        F.dayofmonth("ts").alias("day"),
        "ts",
    )


#: The same as a common table expression `ev`.
EV = f"""ev AS (SELECT event_id AS event_idx, 'v' || user_id AS video, (user_id % 6)::INT AS grp, (user_id % 4)::INT AS camera,
  CASE event_type WHEN 'error' THEN 'tail' WHEN 'view' THEN 'other' ELSE 'ear' END AS behavior, event_type,
  (epoch_us(ts) - {EPOCH}) / 1e6::DOUBLE AS start_sec, value AS duration_sec, json_extract_string(props, '$.k') AS animal_id,
  dayofmonth(ts)::INT AS day, ts FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a prediction table of two classes: the first two components (x 10) as logits, label < 4 as 'tail'."""
    e = table(spark, sf_dir, "embeddings")
    logit = [F.expr(f"cast(element_at(embedding, {i}) as double) * 10") for i in (1, 2)]
    soft = e.select(F.col("vec_id").alias("clip_id"), F.expr("CASE WHEN label < 4 THEN 'tail' ELSE 'ear' END").alias("true_label"), "label", *[x.alias(n) for x, n in zip(logit, ("logit_ear", "logit_tail"))])
    # Rounded, so that engines whose exp differs in the last digit agree on ties and bins.
    p = F.round(1 / (1 + F.exp(F.col("logit_ear") - F.col("logit_tail"))), 6)
    return soft.withColumn("prob_tail", p).withColumn("prob_ear", F.round(1 - F.col("prob_tail"), 6)).withColumn("pred_label", F.expr("CASE WHEN prob_tail > prob_ear THEN 'tail' ELSE 'ear' END"))


PR = """p0 AS (SELECT vec_id AS clip_id, CASE WHEN label < 4 THEN 'tail' ELSE 'ear' END AS true_label, label,
  embedding[1]::DOUBLE * 10 AS logit_ear, embedding[2]::DOUBLE * 10 AS logit_tail FROM embeddings),
pr AS (SELECT *, CASE WHEN prob_tail > prob_ear THEN 'tail' ELSE 'ear' END AS pred_label FROM (
  SELECT *, round(1 - prob_tail, 6) AS prob_ear FROM (SELECT *, round(1 / (1 + exp(logit_ear - logit_tail)), 6) AS prob_tail FROM p0)))"""
