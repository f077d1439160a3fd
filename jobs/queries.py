"""Each job as a query over whole tables, run twice into one new folder, and the SQL of what it leaves there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlake.sources.folders import new_folder

from . import group_report, session_ledger


def job1_session_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):
        session_ledger.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return session_ledger.stored(spark, f"{folder}/out/sessions", session_ledger.SESSIONS)


_LEDGER = session_ledger.settings()

JOB1_SQL = rf"""
WITH l AS (SELECT conv_id, turn, role, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
                  CAST(coalesce(floor(conv_id / {_LEDGER["sessions_per_part"]}), -1) AS BIGINT) AS part FROM conversations),
k AS (SELECT *, count(*) OVER w AS lines, row_number() OVER (w ORDER BY role, words) AS r FROM l WINDOW w AS (PARTITION BY conv_id, turn)),
t AS (SELECT *, lead(role) OVER w AS next, lead(words) OVER w AS reply FROM k WHERE r = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST)),
a AS (SELECT *, coalesce(role = '{_LEDGER["stimulus"]}', false) AS asked, coalesce(role = '{_LEDGER["stimulus"]}' AND next = '{_LEDGER["response"]}', false) AS answered FROM t),
b AS (SELECT *, CASE WHEN answered THEN reply END AS response FROM a)
SELECT part, conv_id, CAST(sum(lines) AS BIGINT) AS n_lines, count(*) AS n_turns, count(*) FILTER (asked) AS n_trials, count(*) FILTER (answered) AS n_answered,
       count(*) FILTER (response < {_LEDGER["least_words"]}) AS n_short, avg(CASE WHEN asked THEN words END) AS stimulus_words, avg(response) AS response_words, stddev_samp(response) AS response_sd,
       coalesce(string_agg(CASE WHEN asked THEN '1' || CASE WHEN NOT answered THEN '*' WHEN response >= {_LEDGER["least_words"]} THEN '1' ELSE '2' END END, ',' ORDER BY turn NULLS LAST), '') AS outcomes,
       count(*) FILTER (asked) > 0 AND count(*) FILTER (answered) >= {_LEDGER["answered_share"]} * count(*) FILTER (asked) AS valid
FROM b GROUP BY part, conv_id
"""


def job2_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of the report, one below the other."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        group_report.run(spark, f"{sf_dir}/events.parquet", folder)
    made = None
    for name in group_report.TABLES:
        own = group_report.read(spark, folder, name).withColumn("report", F.lit(name))
        made = own if made is None else made.unionByName(own, allowMissingColumns=True)
    return made.withColumns({c: F.round(c, 9) for c in ("p", "q")})


_REPORT = group_report.settings()
_ROIS = ", ".join(f"('{name}', {lo}, {hi})" for name, (lo, hi) in _REPORT["rois"].items())

JOB2_SQL = f"""
WITH e AS (SELECT user_id AS subj, event_type AS condition, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS channel, CASE WHEN event_id % 2 = 0 THEN 'HbO' ELSE 'HbR' END AS chrom,
                  epoch_us(ts) / 1000000.0::DOUBLE AS onset, value FROM events),
g AS (SELECT * FROM e WHERE subj IS NOT NULL AND condition IS NOT NULL AND channel IS NOT NULL AND onset IS NOT NULL AND value IS NOT NULL),
b AS (SELECT *, value - avg(value) OVER (PARTITION BY subj) AS v, CASE WHEN onset - lag(onset) OVER (PARTITION BY subj ORDER BY onset) <= {_REPORT["gap_s"]} THEN 0 ELSE 1 END AS new FROM g),
k AS (SELECT *, CAST(sum(new) OVER (PARTITION BY subj ORDER BY onset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM b),
c AS (SELECT subj, condition, channel, chrom, block, avg(v) AS v FROM k GROUP BY ALL),
r AS (SELECT * FROM (VALUES {_ROIS}) AS rois(roi, lo, hi)),
a AS (SELECT subj, condition, roi, chrom, block, avg(v) AS m, count(*) AS n FROM c JOIN r ON channel BETWEEN lo AND hi GROUP BY ALL),
s AS (SELECT condition, roi, chrom, subj, count(*) AS blocks, avg(m) AS m, stddev_samp(m) AS sd, stddev_samp(m) / sqrt(count(*)) AS se, avg(n) AS channels FROM a GROUP BY ALL),
x AS (SELECT condition, roi, chrom, count(m) AS n, avg(m) AS mean, stddev_samp(m) AS sd FROM s GROUP BY ALL),
t AS (SELECT *, sd / sqrt(n) AS se, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t, CASE WHEN n >= 2 THEN n - 1 END AS dof, CASE WHEN sd > 0 THEN mean / sd END AS d FROM x),
u AS (SELECT *, atan(abs(t) / sqrt(dof)) AS th FROM t),
f AS (SELECT condition, roi, chrom, CASE WHEN t IS NULL THEN NULL
        WHEN dof % 2 = 0 THEN 1 - sin(th) * (SELECT sum(exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(th), 2 * j)) FROM range(0, dof // 2) w(j))
        ELSE 1 - 2 / pi() * (th + sin(th) * coalesce((SELECT sum(exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * j + 1)) FROM range(0, (dof - 1) // 2) w(j)), 0)) END AS p FROM u),
h AS (SELECT *, p * count(*) OVER (PARTITION BY p IS NULL) / count(*) OVER (PARTITION BY p IS NULL ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step FROM f),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, min(step) OVER (PARTITION BY p IS NULL ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM h)
SELECT 'blockavg_table' AS report, '{_REPORT["task"]}' AS task, subj AS "subjId", condition, roi, chrom AS chromophore, block AS "blockIndex", m AS "blockMean", n AS "nChannels",
       NULL::BIGINT AS "nBlocks", NULL::DOUBLE AS "meanBlock", NULL::DOUBLE AS "sdBlock", NULL::DOUBLE AS "seBlock", NULL::DOUBLE AS "meanNChannels",
       NULL::BIGINT AS "nSub", NULL::DOUBLE AS mean, NULL::DOUBLE AS sd, NULL::DOUBLE AS se, NULL::DOUBLE AS t, NULL::DOUBLE AS p, NULL::BIGINT AS dof, NULL::DOUBLE AS "cohenD", NULL::DOUBLE AS q, NULL::BOOLEAN AS "qSig" FROM a
UNION ALL
SELECT 'group_blockavg_roi_subjects', '{_REPORT["task"]}', subj, condition, roi, chrom, NULL, NULL, NULL, blocks, m, sd, se, channels, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s
UNION ALL
SELECT 'group_blockavg_roi_stats', '{_REPORT["task"]}', NULL, t.condition, t.roi, t.chrom, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, mean, sd, se, t, round(q.p, 9), dof, d, round(q.q, 9), q.q <= {_REPORT["alpha"]}
FROM t JOIN q ON q.condition = t.condition AND q.roi = t.roi AND q.chrom = t.chrom
"""

QUERIES = {"job1_session_ledger": job1_session_ledger, "job2_group_report": job2_group_report}
ORACLE_SQL = {"job1_session_ledger": JOB1_SQL, "job2_group_report": JOB2_SQL}
