"""Column functions of signals and recordings. All are built-in expressions: no Python on executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """Missing values are null everywhere past a source; a NaN never reaches an aggregate."""
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """Text to double; null where it is no finite number."""
    value = F.expr("try_cast(x as double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def label(c: Column) -> Column:
    """Comparison form of a label."""
    return F.upper(F.trim(c))


def pair_key(src: Column, det: Column) -> Column:
    return F.format_string("%d_%d", src, det)


def db_to_percent(db: Column) -> Column:
    return (F.pow(F.lit(10.0), db / 10) - 1) * 100


def to_db(power: Column, eps: float = 2.220446049250313e-16) -> Column:
    return F.lit(10.0) * F.log10(power + F.lit(eps))


def erd_percent(task: Column, base: Column) -> Column:
    """Change of band power against a baseline in percent; null where there is none."""
    return (F.try_divide(task, base) - 1) * 100


def lateralisation(contra: Column, ipsi: Column) -> Column:
    """(C - I) / (C + I) of sign-flipped changes; null where the sum is 0."""
    return F.try_divide(-contra + ipsi, -contra - ipsi)


def outcome_code(stim: Column, accuracy: Column, answered: Column) -> Column:
    """Trial outcome: kind of stimulus, right or wrong, and no answer, as the recognition task codes them."""
    digit = F.when(~answered, F.lit("*")).when(accuracy == 1, F.lit("1")).otherwise(F.lit("2"))
    return F.concat(stim, digit)


def gamma_hrf(n: int, dt: float, k: int = 6, theta: float = 1.0) -> Column:
    """Haemodynamic response t^(k-1) exp(-t/theta) / (Gamma(k) theta^k) at n times from 0 in steps of dt, peak 1: a constant,
    which no row works out anew."""
    h = [(i * dt) ** (k - 1) * math.exp(-i * dt / theta) / (math.gamma(k) * theta**k) for i in range(n)]
    return F.array(*[F.lit(x / max(h)) for x in h])


def optical_density(value: Column, mean: Column) -> Column:
    """-ln of a value by its channel's mean: infinite for a value of 0, null where it isn't defined."""
    share = F.try_divide(value, mean)
    return F.when(share == 0, F.lit(float("inf"))).otherwise(-F.ln(share))


def dct_order(n: int, dt: float, cutoff_s: float) -> int:
    return int(2 * n * dt / cutoff_s)


def dct_drift(i: Column, n: int, k: int) -> Column:
    """Regressor k of a cosine drift basis over n samples, at sample i."""
    return F.cos(F.lit(math.pi / n) * (i + F.lit(0.5)) * F.lit(k))


def poly_drift(t: Column, mean: Column, furthest: Column, k: int) -> Column:
    """Regressor k of a polynomial drift: time from its mean, by its largest distance, to the k-th power."""
    return F.pow(F.try_divide(t - mean, furthest), F.lit(float(k)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


#: Molar extinction (oxygenated, deoxygenated) of haemoglobin by wavelength in nm, per cm and mole; fixed values of the
#: public tables of tissue optics.
EXTINCTION = {690: (276.0, 2051.96), 760: (586.0, 1548.52), 780: (710.0, 1075.44), 805: (843.0, 810.2), 830: (974.0, 693.04), 850: (1058.0, 691.32)}


def beer_lambert(od: list[Column], wavelengths: list[int], distance_cm: Column, ppf: float = 6.0) -> tuple[Column, Column, Column]:
    """(HbO, HbR, HbT) from optical densities at two or more wavelengths, by least squares on their extinctions."""
    import numpy as np

    e = np.array([EXTINCTION[w] for w in wavelengths]) * math.log(10)
    inverse = np.linalg.pinv(e)
    parts = [sum((F.lit(float(inverse[r, i])) * od[i] for i in range(1, len(od))), F.lit(float(inverse[r, 0])) * od[0]) for r in (0, 1)]
    oxy, deoxy = (F.try_divide(p, distance_cm * F.lit(ppf)) for p in parts)
    return oxy, deoxy, oxy + deoxy
