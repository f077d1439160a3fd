"""Epochs, evoked responses, their measures, and quality of channels and trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import interpolate, range_join
from .tables import nearest_rank, trapezoid

Keys = Sequence[str]
#: Channels that a task gets at once, about.
ROWS = 500_000


def assign_bins(events: DataFrame, bins: DataFrame, code: str = "marker", boundary: int = -99) -> DataFrame:
    """Events with bin and label by their code; boundaries and codes without a bin have null."""
    return events.join(bins.withColumnRenamed("code", code), code, "left").withColumn("bin", F.when(F.col(code) != boundary, F.col("bin")))


def epoch(samples: DataFrame, events: DataFrame, keys: Keys, trial: str, lo: float, hi: float, base: tuple[float, float] | None = None, t: str = "t", value: str = "value", onset: str = "onset_s") -> DataFrame:
    """Samples around each event with time from it (rel_t), less the trial's mean in ``base``."""
    windows = events.select(*keys, trial, F.col(onset).alias("__on"), (F.col(onset) + lo).alias("lo"), (F.col(onset) + hi).alias("hi"), *[c for c in ("bin", "condition") if c in events.columns])
    out = range_join(samples, windows, keys, t=t, bucket_s=max(hi - lo, 1e-6)).withColumn("rel_t", F.col(t) - F.col("__on")).drop("lo", "hi", "__on")
    return baseline(out, [*keys, trial], base, value) if base else out


def baseline(epochs: DataFrame, keys: Keys, base: tuple[float, float], value: str = "value", t: str = "rel_t") -> DataFrame:
    """Values less their mean in ``base``, both ends included; null where it has no sample."""
    mean = F.avg(F.when(F.col(t).between(*base), F.col(value))).over(Window.partitionBy(*keys))
    return epochs.withColumn(value, F.col(value) - mean)


def grid_epochs(samples: DataFrame, events: DataFrame, keys: Keys, trial: str, lo: float, hi: float, dt: float, base: tuple[float, float], **names) -> DataFrame:
    """Epochs on one grid from ``lo`` in steps of ``dt``, interpolated, and baselined."""
    n = int(round((hi - lo) / dt))
    grid = events.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("rel_t", F.lit(lo) + F.col("__k") * F.lit(dt))
    asked = grid.withColumn("t", F.col("onset_s") + F.col("rel_t"))
    found = interpolate(samples, asked.select(*keys, "t").distinct(), keys)
    return baseline(asked.join(found, [*keys, "t"], "left").drop("__k"), [*keys, trial], base)


def block_means(epochs: DataFrame, keys: Keys, dur: float, value: str = "value") -> DataFrame:
    return epochs.where(F.col("rel_t").between(0, dur)).groupBy(*keys).agg(F.avg(value).alias("block_mean"))


def mean_amplitude(erp: DataFrame, keys: Keys, window: tuple[float, float], base: tuple[float, float] | None = None, value: str = "value", t: str = "rel_t") -> DataFrame:
    """Mean in the window, less that in ``base``."""
    inside = lambda w: F.avg(F.when(F.col(t).between(*w), F.col(value)))
    return erp.groupBy(*keys).agg((inside(window) - inside(base) if base else inside(window)).alias("amplitude"))


def local_peak(erp: DataFrame, keys: Keys, window: tuple[float, float], reach: int = 3, value: str = "value", t: str = "rel_t") -> DataFrame:
    """Largest sample of the window above the means of ``reach`` samples on both sides and above its neighbours; where there
    is none, the largest sample."""
    w = Window.partitionBy(*keys).orderBy(t)
    v = F.col(value)
    side = lambda a, b: F.avg(v).over(w.rowsBetween(a, b))
    top = (v > F.lag(v).over(w)) & (v > F.lead(v).over(w)) & (v > side(-reach, -1)) & (v > side(1, reach))
    best = lambda only: F.min_by(F.struct(v.alias("amplitude"), F.col(t).alias("latency")), F.when(only, F.struct(-v, F.col(t))))
    marked = erp.withColumn("__top", F.coalesce(top, F.lit(False))).where(F.col(t).between(*window))
    out = marked.groupBy(*keys).agg(F.max("__top").alias("local"), best(F.col("__top")).alias("a"), best(F.lit(True)).alias("b"))
    return out.select(*keys, "local", *[F.when(F.col("local"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("amplitude", "latency")])


def fractional_area_latency(erp: DataFrame, keys: Keys, window: tuple[float, float], share: float = 0.5, value: str = "value", t: str = "rel_t") -> DataFrame:
    """First time at which ``share`` of the area above 0 is reached."""
    w = Window.partitionBy(*keys).orderBy(t)
    up = F.greatest(F.col(value), F.lit(0.0))
    cut = erp.where(F.col(t).between(*window)).withColumn("__a", F.coalesce((F.col(t) - F.lag(t).over(w)) * (up + F.lag(up).over(w)) / 2, F.lit(0.0)))
    cut = cut.withColumn("__s", F.sum("__a").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__a").over(Window.partitionBy(*keys)))
    return cut.groupBy(*keys).agg(F.min(F.when((F.col("__all") > 0) & (F.col("__s") >= F.col("__all") * share), F.col(t))).alias("latency"))


def onset_latency(erp: DataFrame, keys: Keys, window: tuple[float, float], share: float = 0.5, value: str = "value", t: str = "rel_t") -> DataFrame:
    """First time from which, up to the peak, the curve stays at ``share`` of the peak or more."""
    cut = erp.where(F.col(t).between(*window))
    top = cut.groupBy(*keys).agg(F.max(value).alias("__p"), F.min_by(t, F.struct(-F.col(value), F.col(t))).alias("__at"))
    under = F.max(F.when(F.col(value) < F.col("__p") * share, F.col(t)))
    low = cut.join(top, list(keys)).where(F.col(t) <= F.col("__at")).groupBy(*keys).agg(under.alias("__u"))
    return cut.join(low, list(keys)).where(F.col("__u").isNull() | (F.col(t) > F.col("__u"))).groupBy(*keys).agg(F.min(t).alias("latency"))


def virtual_channel(samples: DataFrame, channels: Sequence[str], name: str, at: Keys, channel: str = "channel", value: str = "value") -> DataFrame:
    """Samples with the mean of some channels as one more."""
    mean = samples.where(F.col(channel).isin(*channels)).groupBy(*at).agg(F.avg(value).alias(value)).withColumn(channel, F.lit(name).cast(samples.schema[channel].dataType))
    return samples.select(*at, channel, value).unionByName(mean.select(*at, channel, value))


def resolve_condition(epoch_events: DataFrame, trial: Keys, latency: str = "latency", bin: str = "bin", kind: str = "type") -> DataFrame:
    """Condition of each epoch: of its event nearest to 0, the bin, else the kind as a number."""
    best = F.min_by(F.struct(bin, kind), F.struct(F.abs(F.col(latency)), F.col(latency)))
    return epoch_events.groupBy(*trial).agg(best.alias("e")).select(*trial, F.coalesce(f"e.{bin}", F.col(f"e.{kind}").try_cast("int")).alias("condition"))


def band_power(spectrum: DataFrame, keys: Keys, bands: dict[str, tuple[float, float]], closed: str = "both") -> DataFrame:
    """Integral of power over each band; ``closed``: "both" ends, or "left"."""
    out = None
    for name, (lo, hi) in bands.items():
        top = F.col("freq") <= hi if closed == "both" else F.col("freq") < hi
        own = trapezoid(spectrum.where((F.col("freq") >= lo) & top), keys, "freq", "power").withColumn("band", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


# --- quality


def channel_snr(samples: DataFrame, keys: Keys, value: str = "value", least: float = 2.0) -> DataFrame:
    """Mean over standard deviation, and whether it is enough."""
    out = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("snr", F.col("mean") / (F.col("sd") + F.lit(2.220446049250313e-16))).withColumn("ok", F.col("snr") >= least)


def auto_range(means: DataFrame, keys: Keys, mean: str = "mean") -> DataFrame:
    """Range of plausible channel means: a tenth of the 1 % value to ten times the 99 % one, by nearest rank."""
    lo = nearest_rank(means, keys, mean, 0.01).withColumnRenamed("quantile", "q01")
    hi = nearest_rank(means, keys, mean, 0.99).withColumnRenamed("quantile", "q99")
    return lo.join(hi, list(keys)).select(*keys, (F.col("q01") * 0.1).alias("lo"), (F.col("q99") * 10).alias("hi"))


def distance_ok(channels: DataFrame, run: Keys, distance: str, lo: float = 0.0, hi: float = 45.0, name: str = "distance_ok") -> DataFrame:
    """Whether each channel's source and detector lie ``lo`` to ``hi`` apart. An unknown distance fails, unless the run has no
    distance at all: then its geometry is unknown, and none fails. Runs are dealt to parts of some ROWS channels, which later
    steps by run keep: a task's memory doesn't grow with the table, but with its largest run."""
    known = F.when(~F.isnan(distance), F.col(distance))
    parts = max(int(channels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-channels.count() // ROWS))
    any_known = F.count(known).over(Window.partitionBy(*run)) > 0
    return channels.repartition(parts, *run).withColumn("__known", any_known).withColumn(name, F.coalesce(known.between(lo, hi), ~F.col("__known"))).drop("__known")


def prune(channels: DataFrame, pair: Keys, wavelength: str, checks: Sequence[Column], n_wavelengths: int) -> DataFrame:
    """Pairs with all wavelengths, all of whose measurements pass every check; a null check passes."""
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(c, F.lit(True))
    out = channels.groupBy(*pair).agg(F.count_distinct(wavelength).alias("n"), F.bool_and(ok).alias("all_ok"), F.count_if(~ok).alias("failed"))
    return out.withColumn("active", F.col("all_ok") & (F.col("n") == n_wavelengths))


def run_flags(runs: DataFrame, active: str = "active_share", motion: str = "motion_share", nonpositive: str = "nonpositive_share") -> DataFrame:
    return runs.withColumns({"low_active": F.col(active) < 0.6, "high_motion": F.col(motion) > 0.2, "non_positive": F.col(nonpositive) > 0.05})


def motion_fraction(mask: DataFrame, keys: Keys, keep: str = "keep") -> DataFrame:
    return mask.groupBy(*keys).agg((1 - F.avg(F.col(keep).cast("double"))).alias("motion"))


def trial_valid(samples: DataFrame, windows: DataFrame, keys: Keys, trial: str, keep: str = "keep", share: float = 0.8) -> DataFrame:
    """Trials with the share of kept samples in their window; valid from ``share`` on, and invalid without samples."""
    inside = range_join(samples, windows, keys).groupBy(*keys, trial).agg(F.avg(F.col(keep).cast("double")).alias("kept"))
    return windows.select(*keys, trial).distinct().join(inside, [*keys, trial], "left").withColumn("valid", F.coalesce(F.col("kept") >= share, F.lit(False)))
