"""Masks, selections, aggregates, windows and sets over long tables of samples, events and results.

Tables are long: a row per sample, event, trial or result, with keys named by the caller. Whatever needs a partition is
partitioned by those keys, so that no recording is gathered with another.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label

Keys = Sequence[str]


# --- masks and selections


def rereference(samples: DataFrame, refs: Sequence[str], at: Keys, channel: str = "channel", value: str = "value") -> DataFrame:
    """Each value less the mean of the channels ``refs`` at the same ``at``; reference channels are dropped."""
    ref = F.avg(F.when(F.col(channel).isin(*refs), F.col(value)))
    mean = samples.groupBy(*at).agg(ref.alias("__ref"))
    return samples.where(~F.col(channel).isin(*refs)).join(mean, list(at)).withColumn(value, F.col(value) - F.col("__ref")).drop("__ref")


def combine_bins(erp: DataFrame, new: dict[str, dict[object, float]], keys: Keys, bin: str = "bin", value: str = "value") -> DataFrame:
    """New bins as weighted sums of others, by one conditional aggregation: null where one of them is missing."""
    sums = []
    for name, terms in new.items():
        parts = [F.sum(F.when(F.col(bin) == F.lit(b), F.col(value))) * F.lit(float(w)) for b, w in terms.items()]
        sums.append(sum(parts[1:], parts[0]).alias(str(name)))
    wide = erp.groupBy(*keys).agg(*sums)
    return wide.unpivot(list(keys), list(map(str, new)), bin, value)


def flag_nonpositive(samples: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Per channel whether any value is 0 or less, which makes it inactive."""
    return samples.groupBy(*keys).agg(F.bool_or(F.col(value) <= 0).alias("nonpositive"), F.count(F.lit(1)).alias("n"))


def runs_to_skip(flags: DataFrame, run: Keys, most: float = 0.05) -> DataFrame:
    """Runs with more than ``most`` of their channels flagged."""
    share = F.avg(F.col("nonpositive").cast("double"))
    return flags.groupBy(*run).agg(share.alias("share")).where(F.col("share") > most)


def assign_roi(df: DataFrame, roi_map: DataFrame, on: Keys) -> DataFrame:
    """Rows with their region. Regions may overlap: a row then stands in each."""
    return df.join(roi_map, list(on))


def propagate_active(od: DataFrame, hb: DataFrame, pair: Keys, active: str = "active") -> DataFrame:
    """Activity of a pair, which all its wavelengths must have, given to its chromophores by the pair itself; else false."""
    pairs = od.groupBy(*pair).agg(F.bool_and(active).alias("__on"))
    return hb.join(pairs, list(pair), "left").withColumn(active, F.coalesce("__on", F.lit(False))).drop("__on")


def attach_mask(samples: DataFrame, mask: DataFrame, on: Keys, keep: str = "keep") -> DataFrame:
    """Samples with a mask; where it has no row, they are kept."""
    return samples.join(mask, list(on), "left").withColumn(keep, F.coalesce(keep, F.lit(True)))


def glm_rows(design: DataFrame, y: str, x: Keys, masks: Keys) -> DataFrame:
    """Rows that a model uses: all masks true, outcome and regressors finite. Regressors must have been convolved before."""
    ok = F.lit(True)
    for m in masks:
        ok = ok & F.col(m)
    for c in (y, *x):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return design.where(ok)


def contralateral(df: DataFrame, side: dict[str, str], condition: str = "condition", roi: str = "roi") -> DataFrame:
    """Rows of a condition in the region opposite to it; conditions that ``side`` doesn't name stay as they are."""
    wanted = F.create_map(*[F.lit(x) for kv in side.items() for x in kv])[F.col(condition)]
    return df.where(wanted.isNull() | (wanted == F.col(roi)))


def drop_rejected(epochs: DataFrame, flags: DataFrame, trial: Keys) -> DataFrame:
    """Trials none of whose flags is set."""
    bad = flags.groupBy(*trial).agg(F.bool_or("value").alias("bad")).where("bad").select(*trial)
    return epochs.join(bad, list(trial), "left_anti")


def select_channel(channels: DataFrame, labels: Sequence[str], keys: Keys, fallback: int | None = None, name: str = "label", index: str = "channel") -> DataFrame:
    """A channel of each recording: the first of ``labels`` that it has in any case, else the one with index ``fallback``."""
    upper = F.upper(F.trim(F.col(name)))
    rank = F.coalesce(*[F.when(upper == x.upper(), F.lit(i)) for i, x in enumerate(labels)], F.when(F.col(index) == F.lit(fallback), F.lit(len(labels))))
    return channels.withColumn("__rank", rank).where("__rank is not null").groupBy(*keys).agg(F.min_by(index, F.struct("__rank", index)).alias(index))


def idle_segments(events: DataFrame, keys: Keys, onset: str = "onset_s", gap_s: float = 2.5, buffer_s: float = 2.0) -> DataFrame:
    """Stretches to keep: runs of events with gaps up to ``gap_s``, with a buffer on each side."""
    blocks = segment_blocks(events, keys, gap_s, onset)
    return blocks.groupBy(*keys, "block").agg((F.min(onset) - buffer_s).alias("lo"), (F.max(onset) + buffer_s).alias("hi"))


# --- aggregates


def summarise(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """n, mean, sd (null for one) and se of finite values."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return out.withColumn("se", F.col("sd") / F.sqrt(F.greatest("n", F.lit(1))))


def roi_mean(df: DataFrame, keys: Keys, value: str = "value", missing: str = "omit") -> DataFrame:
    """Mean over channels; with ``missing="propagate"`` null where any is missing."""
    mean = F.avg(value)
    if missing == "propagate":
        mean = F.when(F.count(value) == F.count(F.lit(1)), mean)
    return df.groupBy(*keys).agg(mean.alias("mean"), F.count(F.lit(1)).alias("n_channels"))


def roi_beta(df: DataFrame, keys: Keys, beta: str = "beta") -> DataFrame:
    """Mean, sd and se of estimates over channels, the se by all channels, those without an estimate too."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_channels"), F.avg(beta).alias("mean_beta"), F.stddev_samp(beta).alias("sd_beta"))
    return out.withColumn("se_beta", F.col("sd_beta") / F.sqrt(F.col("n_channels").cast("double")))


def time_course(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Mean, sd, sem and 95 % half-width at each of ``keys``, which include the time."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return out.withColumn("sem", F.col("sd") / F.sqrt(F.greatest("n", F.lit(1)))).withColumn("ci95", F.col("sem") * 1.96)


def grand_average(erp: DataFrame, subject: str, keys: Keys, value: str = "value") -> DataFrame:
    """Unweighted mean of subjects' means, with its sem."""
    own = erp.groupBy(subject, *keys).agg(F.avg(value).alias("own"))
    return own.groupBy(*keys).agg(F.avg("own").alias("mean"), F.count("own").alias("n"), (F.stddev_samp("own") / F.sqrt(F.count("own"))).alias("sem"))


def rejection_rate(trials: DataFrame, keys: Keys, bin: str, bad: str) -> DataFrame:
    """Rejected share in percent by bin, and with a null bin over all bins."""
    per = trials.groupBy(*keys, bin).agg(F.count_if(bad).alias("rejected"), F.count(F.lit(1)).alias("total"))
    whole = per.groupBy(*keys).agg(F.sum("rejected").alias("rejected"), F.sum("total").alias("total")).withColumn(bin, F.lit(None).cast(trials.schema[bin].dataType))
    return per.unionByName(whole).withColumn("percent", F.try_divide(100.0 * F.col("rejected"), F.col("total")))


def trapezoid(df: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    """Integral of y over x by trapezoids."""
    w = Window.partitionBy(*keys).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("__a", area).groupBy(*keys).agg(F.sum("__a").alias("area"))


def pooled(df: DataFrame, subject: str, level: str, aggs: Sequence[Column], everyone: str = "GroupAll", every: str = "All") -> DataFrame:
    """Aggregates by subject and level, by subject, by level and over all, labelled; one pass of grouping sets."""
    out = df.cube(subject, level).agg(*aggs, F.grouping(subject).alias("__gs"), F.grouping(level).alias("__gl"))
    out = out.withColumn(subject, F.when(F.col("__gs") == 1, F.lit(everyone)).otherwise(F.col(subject).cast("string")))
    return out.withColumn(level, F.when(F.col("__gl") == 1, F.lit(every)).otherwise(F.col(level).cast("string"))).drop("__gs", "__gl")


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins from ``lo`` to ``hi``, the last closed; values outside are not counted."""
    v = F.col(value)
    at = F.when(v == hi, F.lit(bins - 1)).otherwise(F.floor((v - lo) / F.lit((hi - lo) / bins)))
    return df.where((v >= lo) & (v <= hi)).groupBy(at.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- windows and sequences


def intervals(events: DataFrame, keys: Keys, onset: str = "onset_s") -> DataFrame:
    """Events with the time since the one before."""
    return events.withColumn("iti", F.col(onset) - F.lag(onset).over(Window.partitionBy(*keys).orderBy(onset)))


def sample_step(samples: DataFrame, keys: Keys, t: str = "t") -> DataFrame:
    """Median step of a time axis."""
    return intervals(samples, keys, t).groupBy(*keys).agg(F.median("iti").alias("dt"))


def segment_blocks(events: DataFrame, keys: Keys, gap_s: float, onset: str = "onset_s") -> DataFrame:
    """Events with the number of their block, from 1: a gap of more than ``gap_s`` begins a new one."""
    w = Window.partitionBy(*keys).orderBy(onset)
    new = F.coalesce((F.col(onset) - F.lag(onset).over(w) > gap_s).cast("int"), F.lit(1))
    return events.withColumn("__new", new).withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def block_table(events: DataFrame, keys: Keys, gap_s: float, stim_s: float, onset: str = "onset_s") -> DataFrame:
    """Blocks with onset, trials and the recording's median block duration (last less first onset, plus a stimulus)."""
    own = segment_blocks(events, keys, gap_s, onset).groupBy(*keys, "block").agg(F.min(onset).alias("onset"), F.count(F.lit(1)).alias("trials"), (F.max(onset) - F.min(onset) + stim_s).alias("dur"))
    middle = own.groupBy(*keys).agg(F.median("dur").alias("median_dur"))
    return own.join(middle, list(keys))


def mask_segments(samples: DataFrame, keys: Keys, order: str, mask: str, least: float = 6.0, t: str = "t") -> DataFrame:
    """Runs of true of ``least`` seconds or more: start, stop and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce((F.col(mask) != F.lag(mask).over(w)).cast("int"), F.lit(1))
    runs = samples.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(mask)
    out = runs.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("stop") - F.col("start") >= least).drop("run")


def onsets(samples: DataFrame, keys: Keys, order: str, code: str = "code") -> DataFrame:
    """Samples where a code rises from 0; a change from one level to another is none."""
    before = F.lag(code, 1, 0).over(Window.partitionBy(*keys).orderBy(order))
    return samples.withColumn("__b", before).where((F.col("__b") == 0) & (F.col(code) > 0)).drop("__b")


def trigger_codes(bits: DataFrame, keys: Keys, bit: str = "bit", on: str = "on") -> DataFrame:
    """Codes of samples from their set bits."""
    return bits.groupBy(*keys).agg(F.sum(F.when(F.col(on), F.expr(f"shiftleft(1L, {bit})")).otherwise(F.lit(0))).alias("code"))


def moving_mean(df: DataFrame, keys: Keys, order: str, value: str, k: int) -> DataFrame:
    """Centred mean of k samples, fewer at the ends; an even k has one more before than after."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k // 2), (k - 1) // 2)
    return df.withColumn("smooth", F.avg(value).over(w))


def peak_to_peak(df: DataFrame, keys: Keys, value: str, order: str, width: int, step: int, most: float) -> DataFrame:
    """Windows of ``width`` samples, one each ``step``, whose range is above ``most``: by recording the first of each.

    A sample stands in at most width / step windows, to which it is dealt by number: no window function over all samples.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col(order) - (width - 1)) / F.lit(float(step)))).cast("int")
    last = F.floor(F.col(order) / F.lit(float(step))).cast("int")
    dealt = df.where(first <= last).withColumn("win", F.explode(F.sequence(first, last)))
    out = dealt.groupBy(*keys, "win").agg((F.max(value) - F.min(value)).alias("range"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") == width) & (F.col("range") > most)).select(*keys, (F.col("win") * step).alias("start"), "range")


def outside(df: DataFrame, keys: Keys, value: str, lo: float, hi: float) -> DataFrame:
    """Whether any value lies outside ``lo`` to ``hi``."""
    return df.groupBy(*keys).agg(F.bool_or((F.col(value) < lo) | (F.col(value) > hi)).alias("flag"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation from sums; null where it isn't defined. Centre values before if they are large."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = lambda c: F.sum(F.when(both, c))
    n, sx, sy = s(F.lit(1.0)), s(F.col(x)), s(F.col(y))
    sxx, syy, sxy = (s(F.col(a) * F.col(b)) for a, b in ((x, x), (y, y), (x, y)))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(vx * vy)))


def windowed_corr(df: DataFrame, keys: Keys, t: str, x: str, y: str, seconds: float = 10.0, least: int = 10) -> DataFrame:
    """Correlation of x and y in consecutive windows, 0 where negative; windows with fewer samples are left out."""
    out = df.groupBy(*keys, F.floor(F.col(t) / seconds).alias("win")).agg(safe_corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least).withColumn("r", F.greatest(F.lit(0.0), "r"))


def running_sum(df: DataFrame, keys: Keys, order: str, value: str) -> DataFrame:
    return df.withColumn("total", F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


# --- order, sets


def peak(df: DataFrame, keys: Keys, t: str, value: str, polarity: str = "positive") -> DataFrame:
    """Largest value by polarity (positive, negative or absolute) and its time; of equal ones the first."""
    score = {"positive": F.col(value), "negative": -F.col(value), "absolute": F.abs(F.col(value))}[polarity]
    best = F.min_by(F.struct(F.col(value).alias("amplitude"), F.col(t).alias("latency")), F.struct(-score, F.col(t)))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("p")).select(*keys, "p.amplitude", "p.latency")


def nearest_rank(df: DataFrame, keys: Keys, value: str, share: float, slices: int = 1024) -> DataFrame:
    """The value of rank round(share n), at least 1.

    Values are counted in ``slices`` of equal width between the key's least and greatest; only in the slice that holds the
    rank are different values then put in order.
    """
    on = [f"__k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(c) for k, c in zip(keys, on, strict=True)], F.col(value).alias("__v"))
    meet = lambda x, y: x.join(y, functools.reduce(lambda a, b: a & b, [x[c].eqNullSafe(y[f"{c}_"]) for c in on]) if on else F.lit(True)).drop(*[f"{c}_" for c in on])
    renamed = [F.col(c).alias(f"{c}_") for c in on]
    ends = rows.groupBy(*on).agg(F.min("__v").cast("double").alias("__lo"), F.max("__v").cast("double").alias("__hi"), F.count(F.lit(1)).alias("__n")).select(*renamed, "__lo", "__hi", "__n")
    at = F.floor(F.try_divide(F.col("__v").cast("double") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * F.lit(slices))
    part = F.when(F.col("__v").cast("double") == F.col("__hi"), F.lit(slices)).when(F.isnan(F.col("__v").cast("double")), F.lit(slices + 1)).otherwise(F.coalesce(at, F.lit(slices)).cast("int"))
    dealt = meet(rows, ends).select(*on, "__n", part.alias("__p"), "__v")
    rank = F.greatest(F.lit(1), F.round(F.col("__n") * F.lit(share)).cast("long"))
    counts = dealt.groupBy(*on, "__p").agg(F.max("__n").alias("__n"), F.count(F.lit(1)).alias("__c"))
    upto = counts.withColumn("__to", F.sum("__c").over(Window.partitionBy(*on).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)))
    found = upto.where((F.col("__to") >= rank) & (F.col("__to") - F.col("__c") < rank)).select(*renamed, F.col("__p").alias("__p_"), (rank - F.col("__to") + F.col("__c")).alias("__at"))
    same = functools.reduce(lambda a, b: a & b, [dealt[c].eqNullSafe(found[f"{c}_"]) for c in on], dealt["__p"] == found["__p_"])
    inside = dealt.join(found, same).groupBy(*on, "__at", "__v").agg(F.count(F.lit(1)).alias("__c"))
    place = inside.withColumn("__to", F.sum("__c").over(Window.partitionBy(*on).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    last = place.where((F.col("__to") >= F.col("__at")) & (F.col("__to") - F.col("__c") < F.col("__at")))
    return last.select(*[F.col(c).alias(k) for k, c in zip(keys, on, strict=True)], F.col("__v").alias("quantile"))


def first_k(df: DataFrame, keys: Keys, order: Keys, k: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def difference_segments(segments: DataFrame, condition: str, of: object, against: object, at: Keys, value: str = "value", within: Keys = ()) -> DataFrame:
    """Segments of one condition less the other condition's mean at the same places ``at``, of the same ``within``. A place that
    the other condition lacks is left out."""
    on = [*within, *at]
    mean = segments.where(F.col(condition) == F.lit(against)).groupBy(*on).agg(F.avg(value).alias("__m"))
    return segments.where(F.col(condition) == F.lit(of)).join(mean, on).withColumn(value, F.col(value) - F.col("__m")).drop("__m")


def montage(channels: DataFrame, sites: DataFrame, name: str = "label") -> DataFrame:
    """Channels with what ``sites`` has of them, by the comparison form of their labels; channels without a site are left out,
    and of sites with equal labels the least counts."""
    rest = [c for c in sites.columns if c != name]
    own = sites.groupBy(label(F.col(name)).alias("__k")).agg(F.min(F.struct(*rest)).alias("__s")) if rest else sites.select(label(F.col(name)).alias("__k")).distinct()
    joined = channels.withColumn("__k", label(F.col(name))).join(own, "__k")
    return joined.select(*[joined[c] for c in channels.columns if c != name], F.col("__k").alias(name), *[F.col(f"__s.{c}").alias(c) for c in rest])


def preferred_order(df: DataFrame, name: str, first: Sequence[str]) -> DataFrame:
    """Distinct names, the preferred ones first and the others after them by name, with their place."""
    own = df.select(name).distinct().withColumn("__p", F.coalesce(*[F.when(F.col(name) == x, F.lit(i)) for i, x in enumerate(first)], F.lit(len(first))))
    return own.withColumn("place", F.row_number().over(Window.orderBy("__p", name))).drop("__p")


def upsert(old: DataFrame, new: DataFrame, on: Keys) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose names it doesn't have."""
    return old.join(new.select(*on).distinct(), list(on), "left_anti").unionByName(new)


def paired(a: DataFrame, b: DataFrame, subject: str) -> DataFrame:
    """Subjects that both have."""
    return a.select(subject).distinct().join(b.select(subject).distinct(), subject, "left_semi")


def first_match(files: DataFrame, patterns: Sequence[str], keys: Keys, path: str = "path") -> DataFrame:
    """A file for each key: of the first pattern that any file matches."""
    rank = F.coalesce(*[F.when(F.col(path).rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    return files.withColumn("__rank", rank).where("__rank is not null").groupBy(*keys).agg(F.min_by(path, F.struct("__rank", path)).alias(path))


def lookup(df: DataFrame, params: DataFrame, on: Keys, defaults: dict[str, object]) -> DataFrame:
    """Rows with their parameters, and defaults where there are none."""
    return df.join(params, list(on), "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
