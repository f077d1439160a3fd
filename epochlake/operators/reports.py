"""Result tables of a study, with the names and column order in which its users exchange them.

Each takes the long tables of other operators. Column names are the exchange format's, fixed values: they aren't this
library's style.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import benjamini_hochberg, one_sample_t, p_value
from .tables import assign_roi, roi_beta, roi_mean, summarise

Keys = Sequence[str]

#: Columns of each table, by its name. Fixed values of the exchange format.
BLOCKAVG = "subjId", "condition", "roi", "chromophore", "blockIndex", "blockMean", "nChannels"
GLM = "subjId", "task", "measIndex", "src", "det", "chromophore", "roi", "term", "beta", "SE", "t", "p"
GLM_ROI = "subjId", "task", "roi", "chromophore", "term", "nChannels", "meanBeta", "sdBeta", "seBeta"
GROUP_SUBJECTS = "condition", "roi", "chromophore", "subjId", "nBlocks", "meanBlock", "sdBlock", "seBlock", "meanNChannels"
GROUP_STATS = "nSub", "mean", "sd", "se", "t", "p", "dof", "cohenD", "q", "qSig"


def blockavg_table(samples: DataFrame, rois: DataFrame) -> DataFrame:
    """BLOCKAVG of samples (subjId, condition, channel, chromophore, blockIndex, value): channels' means in a block, averaged over
    the channels that ``rois`` (roi, channel) puts in a region. Channels without a value in a block don't count; a block
    without any has no row."""
    own = ["subjId", "condition", "channel", "chromophore", "blockIndex"]
    channels = samples.where("value is not null").groupBy(*own).agg(F.avg("value").alias("value"))
    means = roi_mean(assign_roi(channels, rois, ["channel"]), ["subjId", "condition", "roi", "chromophore", "blockIndex"])
    return means.withColumnsRenamed({"mean": "blockMean", "n_channels": "nChannels"}).select(*BLOCKAVG)


def group_subjects_table(blocks: DataFrame) -> DataFrame:
    """GROUP_SUBJECTS of block averages: a subject's mean over blocks, with its spread."""
    keys = ["condition", "roi", "chromophore", "subjId"]
    means = summarise(blocks, keys, "blockMean").withColumnsRenamed({"n": "nBlocks", "mean": "meanBlock", "sd": "sdBlock", "se": "seBlock"})
    counts = blocks.groupBy(*keys).agg(F.avg("nChannels").alias("meanNChannels"))
    return means.join(counts, keys).select(*GROUP_SUBJECTS)


def group_stats_table(subjects: DataFrame, value: str = "meanBlock", keys: Keys = ("condition", "roi", "chromophore"), alpha: float = 0.05) -> DataFrame:
    """``keys`` and GROUP_STATS: each cell's subjects against 0, by a t test; q over all cells, the right Benjamini-Hochberg one. Cells with
    one subject, or without spread, stay with null t, p and q."""
    cells = one_sample_t(subjects, keys, value)
    tested = benjamini_hochberg(cells.withColumn("p", p_value(F.col("t"), F.col("dof"))), "p", alpha=alpha)
    return tested.withColumnsRenamed({"n": "nSub", "cohen_d": "cohenD", "significant": "qSig"}).select(*keys, *GROUP_STATS)


def glm_table(fits: DataFrame, channels: DataFrame, task: str) -> DataFrame:
    """GLM of estimates (subjId, measIndex, term, beta, se, t, p) and channels (subjId, measIndex, src, det, chromophore, roi)."""
    return fits.withColumnRenamed("se", "SE").join(channels, ["subjId", "measIndex"]).withColumn("task", F.lit(task)).select(*GLM)


def glm_roi_table(table: DataFrame) -> DataFrame:
    """GLM_ROI of a GLM table: estimates over a region's channels."""
    out = roi_beta(table, ["subjId", "task", "roi", "chromophore", "term"])
    return out.withColumnsRenamed({"n_channels": "nChannels", "mean_beta": "meanBeta", "sd_beta": "sdBeta", "se_beta": "seBeta"}).select(*GLM_ROI)
