"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a token budget. Its documents stand in the order of a hash, and the mix takes whole documents of the first
``budget`` words of that stream, which is read again from the start when it is used up. A source's weight schedule over
training time, integrated, says how much of its budget is due by any time; inverting that at the word where a copy of a
document begins gives the time at which it is due. The schedules of all sources together, integrated to that time, say how
many tokens training has then had: that share is the copy's training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, without

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Relative weight at the start and at the end of training, by rank of the source, repeating; linear between.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
#: Added columns.
COLUMNS = ("size", "source_size", "target", "taken", "position", "positions")
#: Leading hex digits of the hash that deal a source's documents out: prefix sums are made in 4,096 parts a source.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget=(3, 2), most=2) -> DataFrame:
    """``sizes`` (source, source_size; a row per source) to (source, source_size, rank, target, goal).

    ``budget`` is the share of all words as a fraction. Targets are proportional to weights and stop at ``most``
    times the source's size; what is above goes to the others by weight until none is above. Sources in ascending
    order of size over weight are stopped up to some place and no further, so one ordered pass finds all. Whole
    numbers are used up to the last division, so any engine gets the same doubles. ``goal`` is the whole part.
    """
    num, den = budget
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_source) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.lit(most * den) * F.col("source_size")
    filled = (
        ranked.withColumn("cap", cap)
        .withColumn("total", F.lit(num) * F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("stopped", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left"))
        .withColumn("free", F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("w"))).over(whole))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(whole))
    )
    share = F.col("w") * F.col("rest")
    return filled.select(
        "source",
        "source_size",
        "rank",
        F.when(F.col("stopped"), F.col("cap") / F.lit(float(den))).otherwise(share / (F.lit(float(den)) * F.col("free"))).alias("target"),
        F.when(F.col("stopped"), F.expr(f"cap div {den}")).otherwise(F.expr(f"(w * rest) div ({den} * free)")).alias("goal"),
    )


def coefficients(schedules=SCHEDULES) -> list[tuple[float, float]]:
    """(a, b) of each schedule: its integral up to x, as a share of the whole, is a x^2 + b x."""
    return [((last - first) / (first + last), 2 * first / (first + last)) for first, last in schedules]


def due_time(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The training time in 0..1 by which ``share`` of a source's budget is due: the inverse of its integrated schedule."""
    out = F.lit(None).cast("double")
    for k, (a, b) in enumerate(coefficients(schedules)):
        x = share if a == 0 else (F.sqrt(F.lit(b * b) + F.lit(4 * a) * share) - F.lit(b)) / F.lit(2 * a)
        out = F.when(rank % len(schedules) == k, x).otherwise(out)
    return out


def demand(goals: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """``goals`` (rank, goal, ..) with a, b and total: by time x, all sources together are due a x^2 + b x of total words."""
    pick = lambda i: F.element_at(F.array(*[F.lit(float(c[i])) for c in coefficients(schedules)]), (F.col("rank") % len(schedules) + 1).cast("int"))
    whole = Window.partitionBy()
    return goals.withColumns({"a": F.sum(F.col("goal") * pick(0)).over(whole), "b": F.sum(F.col("goal") * pick(1)).over(whole), "total_goal": F.sum("goal").over(whole)})


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, schedules=SCHEDULES, budget=(3, 2), most=2, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` (only its columns ``keep``, if given) with size, source_size, target, taken, position and positions.

    size: words of the text (null: 0). taken: words that the mix takes, a whole number of copies, up to ``most``. The copy
    in which a source's budget ends is taken if half of it or more lies before the end, so a source's words differ from its
    target by half a document at most. positions: of each copy, the share of all training tokens before it, by cumulative
    demand; position: of the first, null where nothing is taken. Null sources are one source, ranked last. Rows that
    repeat a key are documents of their own, spread by their texts; equal ones are interchangeable. A document without
    words is never taken. Columns of ``df`` with names of added ones are replaced. Two shuffles of what is kept: none by
    source, so that a source with a third of all rows is spread over 4,096 parts.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    hashed = F.md5(F.concat(F.coalesce(df[key].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(df[text], F.lit("")))))
    base = without(df, *COLUMNS) if keep is None else without(df.select(*keep), *COLUMNS)
    names = base.columns
    rows = df.select(*[df[f"`{c}`"] for c in names], df[source].alias("__source"), hashed.alias("__hash"), word_count(df[text]).alias("__size"))
    part = F.substring("__hash", 1, DIGITS)
    parts = scratch.keep(rows.groupBy(F.col("__source").alias("source"), part.alias("part")).agg(F.sum("__size").alias("part_size")), "parts")
    goals = demand(targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, budget, most), schedules)
    goals = scratch.keep(goals, "goals")
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("part_begin", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).select("source", "part", "part_begin")
    begins = begins.join(goals, begins["source"].eqNullSafe(goals["source"])).select(begins["source"], "part", "part_begin", "source_size", "target", "rank", "goal", "a", "b", "total_goal")
    begins = scratch.keep(begins.toDF(*[f"__b_{c}" for c in begins.columns]), "begins")
    inside = Window.partitionBy("__source", "__part").orderBy("__hash", "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__part", part).withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    placed = placed.join(begins, placed["__source"].eqNullSafe(begins["__b_source"]) & (placed["__part"] == begins["__b_part"]), "left")
    begin, size, goal = F.col("__b_part_begin") + F.col("__before"), F.col("__size"), F.col("__b_goal")
    whole, positions = [], []
    for k in range(most):
        start = begin + k * F.col("__b_source_size")
        taken = (size > 0) & (goal > start) & (2 * (goal - start) >= size)
        x = due_time(F.when(taken, start.cast("double") / goal), F.col("__b_rank"), schedules)
        whole.append(taken.cast("long"))
        positions.append((F.col("__b_a") * x * x + F.col("__b_b") * x) / F.col("__b_total_goal"))
    out = placed.select(
        *[placed[f"`{c}`"] for c in names],
        size.alias("size"),
        F.col("__b_source_size").alias("source_size"),
        F.col("__b_target").alias("target"),
        (size * sum(whole[1:], whole[0])).cast("long").alias("taken"),
        positions[0].alias("position"),
        F.array_compact(F.array(*positions)).alias("positions"),
    )
    return out


def sequence(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of :func:`mix` as the stream that training reads: a row per copy, whole, range-sorted by its position."""
    copies = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return copies.sort("position", key)
