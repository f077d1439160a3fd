"""The quality table of a study: a row for each run, whatever fails.

What goes wrong with a run is data that stays beside its results: :func:`attempt` gives a kernel's error as a row, runs carry
an ``error`` column from stage to stage, and the summary begins with the runs and joins to them what there is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .epochs import auto_range, distance_ok
from .tables import windowed_corr

Keys = Sequence[str]
RUN = ["sub", "run"]
#: Columns of the table, fixed values of the exchange format.
COLUMNS = (
    "sub run inFile outMat nW durationSec nMeasTotal nMeasActive activeMeasFrac motionFrac nonPositiveMeasFrac nonPositiveMeasCount "
    "nFailSNRMeas nFailSDMeas nFailSCIMeas nFailSNRPair nFailSDPair nFailSCIPair flag_nonPositiveCritical flag_nonPositiveSevere "
    "flag_motionDetectFailed flag_motionDetectCritical didTDDR didWavelet sciMedByPair sciGoodPctByPair sciThr sciWlPair dRangeByWl ppfUsed "
    "addedOffset flag_lowActive flag_highMotion note"
).split()


def attempt(df: DataFrame, keys: Keys, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """(keys, schema, error): what ``kernel`` makes of each group, with a null error; where it raises, one row of nulls with
    the error's text. Groups are such as fit one task."""
    out = StructType([df.schema[k] for k in keys] + [StructField(f.name, f.dataType, True) for f in StructType.fromDDL(schema)]).add("error", "string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        try:
            made = kernel(pdf).assign(error=None)
        except Exception as e:  # noqa: BLE001  whatever it is, it is this group's result
            made = pd.DataFrame([{"error": f"{type(e).__name__}: {e}"}])
        return made.assign(**head).reindex(columns=out.names)

    return df.groupBy(*keys).applyInPandas(run, out)


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), " ")


def sci(cardiac: DataFrame, channels: DataFrame, least: float = 0.6, seconds: float = 10.0) -> DataFrame:
    """(sub, run, src, det, sci_med, sci_good): scalp coupling of each pair between a run's shortest and longest wavelength, of
    samples (sub, run, channel, t, value) in the band of the pulse: median over windows, and share of good ones."""
    ends = channels.groupBy(*RUN).agg(F.min("wl").alias("lo"), F.max("wl").alias("hi"))
    own = cardiac.join(channels.select(*RUN, "channel", "src", "det", "wl"), [*RUN, "channel"]).join(ends, RUN)
    of = lambda w: F.max(F.when(F.col("wl") == F.col(w), F.col("value")))
    wide = own.groupBy(*RUN, "src", "det", "t").agg(of("lo").alias("x"), of("hi").alias("y"))
    r = windowed_corr(wide, [*RUN, "src", "det"], "t", "x", "y", seconds)
    return r.groupBy(*RUN, "src", "det").agg(F.median("r").alias("sci_med"), F.avg((F.col("r") >= least).cast("double")).alias("sci_good"))


def qc_summary(
    runs: DataFrame, channels: DataFrame, samples: DataFrame, cardiac: DataFrame | None = None, mask: DataFrame | None = None, snr: float = 2.0, distance: tuple[float, float] = (0.0, 45.0), sci_least: float = 0.6,
    ppf: float = 6.0, least_active: float = 0.6, most_motion: float = 0.2, most_nonpositive: float = 0.05, tddr: bool = True, wavelet: bool = True,
) -> DataFrame:
    """COLUMNS: a row for each of ``runs`` (sub, run, inFile, outMat, error).

    ``channels``: (sub, run, channel, src, det, wl, dist); ``samples``: (sub, run, channel, t, value); ``cardiac``: samples in the
    band of the pulse, or None for no scalp coupling; ``mask``: (sub, run, channel, keep) of samples, or None. A run with an
    error, without channels or samples, or with fewer than two wavelengths has ``ERROR: `` and the reason as its note, and
    nulls. One with too many channels that are 0 or below somewhere is left as it is: it has its counts, and nulls for what
    comes after. A channel's mean, its signal-to-noise ratio, and the range of means at its wavelength are of its samples, and
    unknown (which fails) if any is 0 or below.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    of = samples.groupBy(*RUN, "channel").agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.coalesce(F.bool_or(value <= 0), F.lit(False)).alias("low"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(value).alias("n"))
    chan = channels.join(of, [*RUN, "channel"], "left").withColumn("mean", F.when(~F.col("low"), F.col("m")))
    ranges = auto_range(chan, [*RUN, "wl"])
    chan = distance_ok(chan, RUN, "dist", *distance, name="sd_ok").join(ranges, [*RUN, "wl"], "left")
    chan = chan.withColumn("snr_ok", F.coalesce(F.col("mean") / (F.col("s") + F.lit(2.220446049250313e-16)) >= snr, F.lit(False)))
    chan = chan.withColumn("range_ok", F.coalesce(F.col("mean").between(F.col("lo"), F.col("hi")), F.lit(False)))
    coupled = sci(cardiac, channels, sci_least) if cardiac is not None else None
    if coupled is None:
        chan = chan.withColumns({"sci_med": F.lit(None).cast("double"), "sci_good": F.lit(None).cast("double")})
    else:
        chan = chan.join(coupled, [*RUN, "src", "det"], "left")
    chan = chan.withColumn("sci_ok", F.coalesce(F.col("sci_med") >= sci_least, F.lit(True)))
    waves = chan.groupBy(*RUN).agg(F.count_distinct("wl").alias("nW"))
    ok = F.col("snr_ok") & F.col("sd_ok") & F.col("range_ok") & F.col("sci_ok")
    pairs = chan.groupBy(*RUN, "src", "det").agg(
        *[F.bool_or(~F.col(f"{c}_ok")).alias(f"{c}_fails") for c in ("snr", "sd", "sci")], F.bool_and(ok).alias("fine"), F.count_distinct("wl").alias("w"), F.max("sci_med").alias("sci_med"), F.max("sci_good").alias("sci_good")
    )
    pairs = pairs.join(waves, RUN).withColumn("active", F.col("fine") & (F.col("w") == F.col("nW")))
    text = lambda c: F.when(F.col(c).isNotNull(), F.struct("src", "det", F.format_string("s%d-d%d:%.3f", "src", "det", c).alias("text")))
    by_pair = pairs.groupBy(*RUN).agg(*[F.count_if(f"{c}_fails").alias(f"nFail{n}Pair") for c, n in (("snr", "SNR"), ("sd", "SD"), ("sci", "SCI"))], _joined(F.collect_list(text("sci_med"))).alias("sciMedByPair"), _joined(F.collect_list(text("sci_good"))).alias("sciGoodPctByPair"))
    marked = chan.join(pairs.select(*RUN, "src", "det", "active"), [*RUN, "src", "det"])
    by_channel = marked.groupBy(*RUN).agg(
        F.count_distinct("wl").alias("nW"), (F.max("t1") - F.min("t0")).alias("durationSec"), F.count(F.lit(1)).alias("nMeasTotal"), F.count_if("active").alias("nMeasActive"), F.count_if("low").alias("nonPositiveMeasCount"), F.sum("n").alias("n"),
        *[F.count_if(~F.col(f"{c}_ok")).alias(f"nFail{n}Meas") for c, n in (("snr", "SNR"), ("sd", "SD"), ("sci", "SCI"))], F.min("wl").alias("w0"), F.max("wl").alias("w1"),
    )
    dr = ranges.groupBy(*RUN).agg(_joined(F.collect_list(F.struct("wl", F.format_string("wl%d:[%.3f %.3f]", F.col("wl").cast("int"), "lo", "hi").alias("text")))).alias("dRangeByWl"))
    out = runs.join(by_channel, RUN, "left").join(by_pair, RUN, "left").join(dr, RUN, "left")
    if mask is not None:
        moved = mask.join(marked.where("active").select(*RUN, "channel"), [*RUN, "channel"]).groupBy(*RUN).agg((1 - F.avg(F.col("keep").cast("double"))).alias("motionFrac"))
        out = out.join(moved, RUN, "left").join(mask.select(*RUN).distinct().withColumn("masked", F.lit(True)), RUN, "left")
    else:
        out = out.withColumns({"motionFrac": F.lit(None).cast("double"), "masked": F.lit(None).cast("boolean")})
    reason = F.coalesce(
        F.col("error") if "error" in runs.columns else F.lit(None).cast("string"),
        F.when(F.coalesce("nMeasTotal", F.lit(0)) == 0, F.lit("no channels")),
        F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("no samples")),
        F.when(F.col("nW") < 2, F.lit("fewer than two wavelengths")),
    )
    out = out.withColumns({"reason": reason, "nonPositiveMeasFrac": F.try_divide("nonPositiveMeasCount", "nMeasTotal")})
    severe = F.col("nonPositiveMeasFrac") > most_nonpositive
    active = F.try_divide("nMeasActive", "nMeasTotal")
    failed = F.col("masked").isNull()
    notes = [F.when(F.col("nonPositiveMeasCount") > 0, F.lit("[nonPositiveIntensity]")), F.when(severe, F.lit("[nonPositiveSevere->skip]")), F.when(~severe & failed, F.lit("[motionDetectFailed]"))]
    whole = {"nW", "durationSec", "nMeasTotal", "nonPositiveMeasCount", "nonPositiveMeasFrac", "flag_nonPositiveCritical", "flag_nonPositiveSevere", "addedOffset"}
    made: dict[str, Column] = {c: F.col(c) for c in ("nW", "durationSec", "nMeasTotal", "nMeasActive", "motionFrac", "nonPositiveMeasFrac", "nonPositiveMeasCount", "sciMedByPair", "sciGoodPctByPair", "dRangeByWl")}
    made |= {f"nFail{n}{of}": F.col(f"nFail{n}{of}") for n in ("SNR", "SD", "SCI") for of in ("Meas", "Pair")}
    made |= {"activeMeasFrac": active, "flag_nonPositiveCritical": F.col("nonPositiveMeasCount") > 0, "flag_nonPositiveSevere": severe, "flag_motionDetectFailed": failed, "flag_motionDetectCritical": failed | F.col("motionFrac").isNull()}
    made |= {"didTDDR": F.lit(tddr), "didWavelet": F.lit(wavelet), "sciThr": F.lit(float(sci_least)), "sciWlPair": F.format_string("wl%d-wl%d", F.col("w0").cast("int"), F.col("w1").cast("int")), "addedOffset": F.lit(0.0)}
    made |= {"ppfUsed": F.array_join(F.array_repeat(F.lit(f"{ppf:g}"), F.col("nW").cast("int")), " "), "flag_lowActive": active < least_active, "flag_highMotion": F.col("motionFrac") > most_motion, "outMat": F.col("outMat")}
    made = {c: F.when(F.col("reason").isNull() & (F.lit(True) if c in whole else ~severe), v) for c, v in made.items()}
    made["note"] = F.when(F.col("reason").isNotNull(), F.concat(F.lit("ERROR: "), "reason")).otherwise(F.concat_ws(" ", *notes))
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in COLUMNS])
