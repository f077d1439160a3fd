"""Ledger of sessions from their text logs, kept up to date as logs arrive.

    python -m jobs.session_ledger --logs DIR/conversations.parquet --out OUT --checkpoint CHECKPOINT [--config jobs/session_ledger.json]

A log line is a turn of a session: who speaks, and the text. A trial is a stimulus, from its line to before the next; its
response is the line right after it, if that is by the one who responds. A stream with a checkpoint takes the files that no
run has read and adds what it needs of their lines to ``OUT/lines``. Sessions are then worked out anew in those partitions of
``OUT/sessions`` whose lines are not all accounted for there, and only those are replaced; sessions are dealt to partitions in
the order of their numbers, so new ones touch few. A run that fails between the two steps is made good by the next, and a run
without new files changes nothing.

Lines that repeat a session's turn count in n_lines; their text is that of the least by speaker and words. A line without
session is of the session without number, and lines without a turn come last in theirs. A missing text has no words; a
missing speaker neither asks nor responds.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from epochlake.functions.scalars import outcome_code
from epochlake.operators.tables import summarise

log = logging.getLogger("jobs.session_ledger")

SCHEMA = "conv_id long, turn long, role string, text string"
SESSIONS = "conv_id long, n_lines long, n_turns long, n_trials long, n_answered long, n_short long, stimulus_words double, response_words double, response_sd double, outcomes string, valid boolean, part long"


def settings(path: str | None = None) -> dict:
    with open(path or os.path.join(os.path.dirname(__file__), "session_ledger.json"), encoding="utf-8") as f:
        return json.load(f)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table as far as it has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def take(spark: SparkSession, logs: str, out: str, checkpoint: str, config: dict) -> int:
    """Add the lines of new files to the ledger; how many there were. ``logs``: a folder, a glob of files, or one file."""
    if not any(c in logs for c in "*?[{"):
        logs = f"{logs.rstrip('/')[:-1]}[{logs.rstrip('/')[-1]}]"  # as a glob, a file will do as well as a folder
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    part = F.coalesce(F.floor(F.col("conv_id") / F.lit(int(config["sessions_per_part"]))), F.lit(-1)).cast("long")
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(logs)
    lines = lines.select("conv_id", "turn", "role", words.cast("long").alias("words"), part.alias("part"))
    query = lines.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("part").trigger(availableNow=True).start(f"{out}/lines")
    try:
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)
    finally:
        query.stop()


LINES = "conv_id long, turn long, role string, words long, part long"


def stale(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """(part): partitions whose lines sessions don't account for."""
    there = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    known = sessions.groupBy("part").agg(F.sum("n_lines").alias("m"))
    return there.join(known, "part", "left").where(F.coalesce("m", F.lit(0)) != F.col("n")).select("part")


def worked_out(lines: DataFrame, config: dict) -> DataFrame:
    """(part, conv_id, ...): a row for each session."""
    keys = ["part", "conv_id"]
    turns = lines.groupBy(*keys, "turn").agg(F.count(F.lit(1)).alias("lines"), F.min(F.struct("role", "words")).alias("l"))
    after = lambda c: F.lead(c).over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("turn")))
    rows = turns.select(*keys, "turn", "lines", F.coalesce("l.role", F.lit("")).alias("role"), F.col("l.words").alias("words"))
    rows = rows.withColumns({"next": after("role"), "reply": after("words")})
    asked = F.col("role") == config["stimulus"]
    answered = asked & F.coalesce(F.col("next") == config["response"], F.lit(False))
    rows = rows.withColumns({"asked": asked, "answered": answered, "response": F.when(answered, F.col("reply"))})
    code = outcome_code(F.lit("1"), (F.col("response") >= int(config["least_words"])).cast("int"), F.col("answered"))
    marks = F.array_sort(F.collect_list(F.when(F.col("asked"), F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), code.alias("code")))))
    own = rows.groupBy(*keys).agg(
        F.sum("lines").alias("n_lines"),
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if("asked").alias("n_trials"),
        F.count_if("answered").alias("n_answered"),
        F.count_if(F.col("response") < int(config["least_words"])).alias("n_short"),
        F.avg(F.when(F.col("asked"), F.col("words"))).alias("stimulus_words"),
        F.array_join(F.transform(marks, lambda m: m["code"]), ",").alias("outcomes"),
    )
    spread = summarise(rows.withColumn("response", F.col("response").cast("double")), keys, "response").select(*keys, F.col("mean").alias("response_words"), F.col("sd").alias("response_sd"))
    same = own["part"].eqNullSafe(spread["part"]) & own["conv_id"].eqNullSafe(spread["conv_id"])
    out = own.join(spread, same).drop(spread["part"], spread["conv_id"])
    valid = F.coalesce(F.col("n_answered") >= F.lit(float(config["answered_share"])) * F.col("n_trials"), F.lit(False)) & (F.col("n_trials") > 0)
    return out.withColumn("valid", valid).select(*[c.strip().split(" ")[0] for c in SESSIONS.split(",")])


def run(spark: SparkSession, logs: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Take what is new at ``logs`` and bring ``out`` up to date; what was read and written."""
    config = config or settings()
    taken = take(spark, logs, out, checkpoint, config)
    lines, sessions = stored(spark, f"{out}/lines", LINES), stored(spark, f"{out}/sessions", SESSIONS)
    stale(lines, sessions).write.mode("overwrite").parquet(f"{out}/stale")  # stored: what replaces partitions doesn't read them
    todo = spark.read.schema("part long").parquet(f"{out}/stale")
    n = todo.count()
    if n:
        fresh = worked_out(lines.join(todo, "part", "left_semi"), config)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{out}/sessions")
    told = {"lines_taken": taken, "parts_replaced": n, "sessions": stored(spark, f"{out}/sessions", SESSIONS).count()}
    log.info("read %d new lines of %s; replaced %d partitions of %s/sessions, which has %d sessions", taken, logs, n, out, told["sessions"])
    return told


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    for name in ("--logs", "--out", "--checkpoint"):
        args.add_argument(name, required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("session_ledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.logs, given.out, given.checkpoint, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
