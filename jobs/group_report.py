"""Group report of a study: block averages by region, subjects' means and group statistics, from its event log.

    python -m jobs.group_report --events DIR/events.parquet --out OUT [--config jobs/group_report.json]

Blocks are a subject's events without a longer gap. Values are taken from the subject's mean, averaged by channel in a block,
then over the channels of each region. Written as ``OUT/<table>``, partitioned by task: a run replaces its own task's partition
of each table and leaves those of others, so one folder holds a study's tasks, and a rerun gives the same tables.

A value, a time or a channel that is missing leaves its event out; a subject without any has no rows. Rows that repeat an
event_id are read once, the one that is least by time, subject, kind and value.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlake.operators import reports
from epochlake.operators.tables import segment_blocks

log = logging.getLogger("jobs.group_report")

TABLES = {
    "blockavg_table": "subjId long, condition string, roi string, chromophore string, blockIndex long, blockMean double, nChannels long",
    "group_blockavg_roi_subjects": "condition string, roi string, chromophore string, subjId long, nBlocks long, meanBlock double, sdBlock double, seBlock double, meanNChannels double",
    "group_blockavg_roi_stats": "condition string, roi string, chromophore string, nSub long, mean double, sd double, se double, t double, p double, dof long, cohenD double, q double, qSig boolean",
}


def settings(path: str | None = None) -> dict:
    with open(path or os.path.join(os.path.dirname(__file__), "group_report.json"), encoding="utf-8") as f:
        return json.load(f)


def measured(events: DataFrame, gap_s: float) -> DataFrame:
    """(subjId, condition, channel, chromophore, blockIndex, value) of an event log."""
    least = F.min(F.struct("ts", "user_id", "event_type", "value", "props")).alias("e")
    once = events.groupBy("event_id").agg(least).select("event_id", "e.*")
    onset = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2000-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1000000D")
    rows = once.select(
        F.col("user_id").alias("subjId"),
        F.col("event_type").alias("condition"),
        F.get_json_object("props", "$.k").try_cast("int").alias("channel"),
        F.when(F.col("event_id") % 2 == 0, F.lit("HbO")).otherwise(F.lit("HbR")).alias("chromophore"),
        onset.alias("onset_s"),
        F.when(~F.isnan("value"), F.col("value")).alias("value"),
    ).dropna()
    centre = rows.groupBy("subjId").agg(F.avg("value").alias("centre"))
    blocks = segment_blocks(rows, ["subjId"], gap_s).withColumnRenamed("block", "blockIndex")
    return blocks.join(centre, "subjId").select("subjId", "condition", "channel", "chromophore", "blockIndex", (F.col("value") - F.col("centre")).alias("value"))


def run(spark: SparkSession, events_path: str, out: str, config: dict | None = None) -> None:
    """Write the report's tables of the events at ``events_path`` under ``out``."""
    config = config or settings()
    pairs = [(name, c) for name, (lo, hi) in config["rois"].items() for c in range(lo, hi + 1)]
    rois = spark.createDataFrame(pairs, "roi string, channel int")
    events = spark.read.parquet(events_path)
    blocks, subjects, stats = TABLES
    write(out, blocks, reports.blockavg_table(measured(events, float(config["gap_s"])), rois), config["task"])
    write(out, subjects, reports.group_subjects_table(own(spark, out, blocks, config["task"])), config["task"])
    write(out, stats, reports.group_stats_table(own(spark, out, subjects, config["task"]), alpha=float(config["alpha"])), config["task"])
    log.info("read %d events of %s", events.count(), events_path)
    for name in TABLES:
        log.info("wrote %d rows of task %s to %s/%s", own(spark, out, name, config["task"]).count(), config["task"], out, name)


def write(out: str, name: str, df: DataFrame, task: str) -> None:
    df.withColumn("task", F.lit(task)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task").parquet(f"{out}/{name}")


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[name]}, task string").parquet(f"{out}/{name}")


def own(spark: SparkSession, out: str, name: str, task: str) -> DataFrame:
    """A table's rows of a task."""
    return read(spark, out, name).where(F.col("task") == task).drop("task")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    args.add_argument("--events", required=True)
    args.add_argument("--out", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("group_report").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.events, given.out, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
