"""Group statistics and linear models.

Sums are made by distributed aggregation; what remains, a few numbers for each group, goes through small kernels.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .robust import biweight
from .signal import arrays, packed
from .tables import safe_corr

Keys = Sequence[str]


def _fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(d0 := 1 - (a + b) * x / (a + 1)) < tiny, tiny, d0)
    out = d.copy()
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(e := 1 + k * d) < tiny, tiny, e)
            c = np.where(np.abs(e := 1 + k / c) < tiny, tiny, e)
            out *= c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return out


def two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t, from the lower tail, so that small ones keep their digits. NaN where dof < 1."""
    t, v = np.asarray(t, float), np.asarray(dof, float)
    ok = np.isfinite(t) & (v >= 1)
    out = np.full(t.shape, np.nan)
    if ok.any():
        t, v = np.abs(t[ok]), v[ok]
        x = v / (v + t * t)
        a, b = v / 2, 0.5
        gamma = np.vectorize(math.lgamma)
        front = np.exp(gamma(a + b) - gamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-np.minimum(x, 1 - 1e-16)))
        direct = x < (a + 1) / (a + b + 2)
        lower = front * _fraction(a, b, x) / a
        upper = 1 - np.exp(gamma(a + b) - gamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) * _fraction_swapped(a, b, x) / b
        out[ok] = np.where(t == 0, 1.0, np.where(direct, lower, upper))
    return out


def _fraction_swapped(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    return _fraction(np.full_like(a, b), a, 1 - x)


def p_value(t: Column, dof: Column) -> Column:
    """Column form of :func:`two_sided_p`, for tables of results."""

    @F.pandas_udf("double")
    def run(t: pd.Series, dof: pd.Series) -> pd.Series:
        p = pd.Series(two_sided_p(t.to_numpy(float), dof.to_numpy(float)))
        return p.astype(object).where(p.notna(), None)

    return run(t.cast("double"), dof.cast("double"))


def one_sample_t(df: DataFrame, keys: Keys, value: str, mu: float = 0.0) -> DataFrame:
    """n, mean, sd, se, t, dof and Cohen's d against ``mu``; the last four null where n < 2 or all values are equal."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = out.withColumn("se", F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return out.withColumns({"t": F.try_divide(F.col("mean") - mu, "se"), "dof": F.when(F.col("n") >= 2, F.col("n") - 1), "cohen_d": F.try_divide(F.col("mean") - mu, "sd")})


def welch_t(df: DataFrame, keys: Keys, group: str, a: object, b: object, value: str) -> DataFrame:
    """Means of two groups, Welch's t and its degrees of freedom."""
    of = lambda f, g: f(F.when(F.col(group) == F.lit(g), F.col(value)))
    out = df.groupBy(*keys).agg(of(F.count, a).alias("na"), of(F.count, b).alias("nb"), of(F.avg, a).alias("ma"), of(F.avg, b).alias("mb"), of(F.var_samp, a).alias("va"), of(F.var_samp, b).alias("vb"))
    qa, qb = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    return out.withColumn("t", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(qa + qb))).withColumn("dof", F.try_divide((qa + qb) * (qa + qb), F.try_divide(qa * qa, F.col("na") - 1) + F.try_divide(qb * qb, F.col("nb") - 1)))


def benjamini_hochberg(df: DataFrame, p: str, family: Keys = (), alpha: float = 0.05) -> DataFrame:
    """``df`` with q, the least level at which a discovery stands, and whether it is at most ``alpha``; null p stays null.

    Equal p get equal q. A family is a table of tests, which one task sorts.
    """
    w = Window.partitionBy(*family, F.col(p).isNull())
    down = w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    step = F.col(p) * F.count(F.lit(1)).over(w) / F.count(F.lit(1)).over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("__s", step)
    q = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__s").over(down)))
    return out.withColumn("q", q).withColumn("significant", F.col("q") <= alpha).drop("__s")


def pearson(df: DataFrame, keys: Keys, x: str, y: str, ids: str | None = None, least: int = 3) -> DataFrame:
    """n, r, t, dof of each cell; r null where n < ``least`` or a variance is 0. Cells are kept anyhow. With ``ids`` the subjects
    of a cell too, as one string: for studies whose subjects can be listed."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    n = F.count_if(both)
    out = df.groupBy(*keys).agg(n.alias("n"), F.when(n >= least, safe_corr(x, y)).alias("r"), *([F.array_join(F.array_sort(F.collect_list(F.when(both, F.col(ids).cast("string")))), ",").alias("subjects")] if ids else []))
    return out.withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)).cast("double")), F.sqrt(1 - F.col("r") * F.col("r")))).withColumn("dof", F.col("n") - 2)


def linear_fit(df: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def moments(df: DataFrame, keys: Keys, y: str, x: Keys) -> DataFrame:
    """Sums that least squares needs, of rows without nulls: n, xx (upper triangle, row by row), xy and yy."""
    ok = F.col(y).isNotNull()
    for c in x:
        ok = ok & F.col(c).isNotNull()
    xx = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(x) for b in x[i:]]
    return df.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*xx).alias("xx"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in x]).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))


def solve(n: int, xx: np.ndarray, xy: np.ndarray, yy: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(beta, covariance, degrees of freedom) of a least-squares fit from its sums, by the pseudo-inverse."""
    p = len(xy)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = xx
    full = full + np.triu(full, 1).T
    inverse = np.linalg.pinv(full)
    beta = inverse @ xy
    dof = n - p
    s2 = max(0.0, yy - beta @ xy) / dof if dof > 0 else np.nan
    return beta, s2 * inverse, dof


def ols(df: DataFrame, keys: Keys, y: str, x: Keys, contrasts: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """(keys, term, beta, se, t, p, dof): least squares of ``y`` on ``x`` for each key, and contrasts of the estimates.

    Products are summed where the samples are; a kernel gets the sums of each key only. Keys with no more rows than
    regressors are left out; a contrast without variance has null se, t and p.
    """
    weights = contrasts or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.n <= len(x):
                    continue
                beta, cov, dof = solve(row.n, np.array(row.xx), np.array(row.xy), row.yy)
                terms = [(name, np.eye(len(x))[i]) for i, name in enumerate(x)] + [(k, np.array(v, float)) for k, v in weights.items()]
                for name, c in terms:
                    b, v = float(c @ beta), float(c @ cov @ c)
                    se = math.sqrt(v) if v > 0 else np.nan
                    out.append([*[getattr(row, k) for k in keys], name, b, se, b / se if se == se else np.nan, dof])
            res = pd.DataFrame(out, columns=[*keys, "term", "beta", "se", "t", "dof"])
            res["p"] = two_sided_p(res["t"].to_numpy(float), res["dof"].to_numpy(float)) if len(res) else []
            yield res[[*keys, "term", "beta", "se", "t", "p", "dof"]]

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return moments(df, keys, y, x).mapInPandas(run, f"{kinds}, term string, beta double, se double, t double, p double, dof bigint")


def orthogonalise(df: DataFrame, keys: Keys, names: Keys, against: Keys) -> DataFrame:
    """``df`` with each of ``names`` less its projection on the columns ``against``, by key: what of a regressor others don't say.

    Products are summed where the samples are; a kernel gets the sums of each key. Rows with a null in any of these columns
    don't count, and have null there. Columns that depend on each other, or are 0, are no harm.
    """
    ok = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*names, *against)])
    each = [F.sum(F.col(a) * F.col(b)) for a in against for b in (*against, *names)]
    sums = df.where(ok).groupBy(*keys).agg(F.array(*each).alias("__s"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(against)
        for pdf in batches:
            found = [np.asarray(v, float).reshape(p, -1) for v in pdf["__s"]]
            yield pdf[list(keys)].assign(__b=[(np.linalg.pinv(m[:, :p], hermitian=True) @ m[:, p:]).T.ravel().tolist() for m in found])

    fits = sums.mapInPandas(run, f"{kinds}, __b array<double>")
    less = {n: F.col(n) - sum((F.col("__b")[i * len(against) + j] * F.col(a) for j, a in enumerate(against)), F.lit(0.0)) for i, n in enumerate(names)}
    return df.join(fits, list(keys), "left").withColumns(less).drop("__b")


def lagged(df: DataFrame, keys: Keys, order: str, y: str, u: str, na: int, nb: int, delay: int) -> tuple[DataFrame, list[str]]:
    """Regressors of an ARX model: past outputs and inputs within a segment; null where it hasn't that many."""
    w = Window.partitionBy(*keys).orderBy(order)
    cols = {f"y{k}": F.lag(y, k).over(w) for k in range(1, na + 1)} | {f"u{k}": F.lag(u, delay + k).over(w) for k in range(nb)}
    return df.withColumns(cols), list(cols)


def arx(df: DataFrame, subject: Keys, segment: str, order: str, y: str, u: str, na: int = 2, nb: int = 2, delay: int = 1) -> DataFrame:
    """ARX(na, nb, delay) of each subject, pooled over its segments."""
    rows, names = lagged(df, [*subject, segment], order, y, u, na, nb, delay)
    return ols(rows, subject, y, names)


def impulse_response(a: np.ndarray, b: np.ndarray, delay: int, n: int, dt: float) -> dict:
    """Of y_t = sum a_k y_(t-k) + sum b_k u_(t-delay-k): response, peak and its lag, gain at rest, slowest time constant."""
    h = np.zeros(n)
    for t in range(n):
        h[t] = sum(a[k] * h[t - 1 - k] for k in range(len(a)) if t - 1 - k >= 0) + (b[t - delay] if 0 <= t - delay < len(b) else 0)
    at = int(np.argmax(np.abs(h)))
    poles = np.abs(np.roots(np.r_[1, -a])) if len(a) else np.zeros(0)
    pole = float(poles.max(initial=0))
    den = 1 - a.sum()
    return {"irf": h, "peak": float(h[at]), "lag": at * dt, "gain": float(b.sum() / den) if den else float("nan"), "tau": -dt / math.log(pole) if 0 < pole < 1 else float("nan")}


def simulate(a: np.ndarray, b: np.ndarray, delay: int, u: np.ndarray) -> np.ndarray:
    """The model's output for ``u`` from rest, without looking at what was measured."""
    y = np.zeros(len(u))
    for t in range(len(u)):
        y[t] = sum(a[k] * y[t - 1 - k] for k in range(len(a)) if t - 1 - k >= 0) + sum(b[k] * u[t - delay - k] for k in range(len(b)) if t - delay - k >= 0)
    return y


def polynomials(fits: DataFrame, subject: Keys, na: int, nb: int) -> DataFrame:
    """(subject, a, b): the estimates of :func:`arx` as arrays, of past outputs and of inputs."""
    of = lambda n: F.max(F.when(F.col("term") == n, F.col("beta")))
    return fits.groupBy(*subject).agg(F.array(*[of(f"y{k}") for k in range(1, na + 1)]).alias("a"), F.array(*[of(f"u{k}") for k in range(nb)]).alias("b"))


def responses(fits: DataFrame, subject: Keys, na: int, nb: int, delay: int, n: int, dt: float) -> DataFrame:
    """(subject, peak, lag, gain, tau, irf) of each subject's ARX model, by :func:`impulse_response`; null where there is none."""
    rows = polynomials(fits, subject, na, nb)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in subject)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [impulse_response(np.asarray(a, float), np.asarray(b, float), delay, n, dt) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            out = pdf[list(subject)].assign(**{c: [m[c] for m in made] for c in ("peak", "lag", "gain", "tau")}, irf=[m["irf"].tolist() for m in made])
            yield out.astype({c: object for c in ("gain", "tau")}).where(out.notna(), None)

    return rows.mapInPandas(run, f"{kinds}, peak double, lag double, gain double, tau double, irf array<double>")


def simulation_scores(df: DataFrame, fits: DataFrame, subject: Keys, segment: str, order: str, y: str, u: str, na: int, nb: int, delay: int) -> DataFrame:
    """(subject, segment, n, rmse, r): how well each subject's ARX model, run freely from rest on a segment's input, gives its
    output, after the first samples that the model looks back on.

    A sample with a missing input or output ends a run: the next begins anew, from rest, and its first samples don't count
    either. n: the samples that count, over all runs; without any, rmse and r are null. r is null too where one of both
    doesn't vary."""
    keys, skip = [*subject, segment], max(na, delay + nb - 1)
    rows = packed(df, keys, order, [y, u]).join(polynomials(fits, subject, na, nb), list(subject))
    rows = rows.select(*keys, y, u, "a", "b")
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def score(v: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        have = np.flatnonzero(np.isfinite(v) & np.isfinite(x))
        runs = np.split(have, np.flatnonzero(np.diff(have) > 1) + 1)
        free = np.concatenate([np.zeros(0), *[simulate(a, b, delay, x[r])[skip:] for r in runs]])
        v = v[np.concatenate([np.zeros(0, int), *[r[skip:] for r in runs]])]
        fits = len(v) > 0 and np.isfinite(free).all()
        vary = fits and len(v) > 1 and v.std() > 0 and free.std() > 0
        return len(v), float(np.sqrt(np.mean((v - free) ** 2))) if fits else None, float(np.corrcoef(v, free)[0, 1]) if vary else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [score(*(np.asarray(c, float) for c in row)) for row in zip(pdf[y], pdf[u], pdf["a"], pdf["b"], strict=True)]
            yield pdf[keys].assign(n=[o[0] for o in out], rmse=[o[1] for o in out], r=[o[2] for o in out])

    return rows.mapInPandas(run, f"{kinds}, n int, rmse double, r double")


def kalman(y: np.ndarray, x: np.ndarray, lam: float = 0.98, q: float = 1e-4, r: float = 1.0, p0: float = 1e3, state=None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(parameters after each sample, predictions before it, state): recursive least squares with forgetting, of one series or,
    with a leading axis, of many of equal length together."""
    if y.ndim == 1:
        before = None if state is None else tuple(v[None] for v in state)
        path, ahead, after = kalman(y[None], x[None], lam, q, r, p0, before)
        return path[0], ahead[0], tuple(v[0] for v in after)
    n, m = x.shape[0], x.shape[2]
    theta, p = state if state is not None else (np.zeros((n, m)), np.tile(np.eye(m) * p0, (n, 1, 1)))
    path, ahead = np.zeros((*y.shape, m)), np.zeros(y.shape)
    for t in range(y.shape[1]):
        row = x[:, t]
        p = p / lam + q * np.eye(m)
        ahead[:, t] = np.einsum("ni,ni->n", row, theta)
        side = np.einsum("nij,nj->ni", p, row)
        gain = side / (np.einsum("ni,ni->n", row, side) + r)[:, None]
        theta = theta + gain * (y[:, t] - ahead[:, t])[:, None]
        p = p - gain[:, :, None] * np.einsum("ni,nij->nj", row, p)[:, None, :]
        path[:, t] = theta
    return path, ahead, (theta, p)


def together(df: DataFrame, keys: Keys, order: str, y: str, x: Keys, schema: str, kernel) -> DataFrame:
    """Rows that ``kernel`` (y, x, and where each channel stands) makes of channels, those of equal length together, after rows
    with a missing value are left out. It yields (channel, values after the keys)."""
    rows = packed(df, keys, order, [y, *x])
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[c.strip().split(" ")[0] for c in schema.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [arrays(part.column(len(keys) + 1 + i)) for i in range(1 + len(x))]
                whole = [np.isfinite(np.stack(v)).all(0) if len(v[0]) else np.zeros(0, bool) for v in zip(*data, strict=True)]
                sizes = np.array([int(w.sum()) for w in whole])
                head = part.select(list(keys)).to_pylist()
                out = []
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    ys = np.stack([data[0][i][whole[i]] for i in own])
                    xs = np.stack([np.stack([d[i][whole[i]] for d in data[1:]], 1) for i in own])
                    out += [(int(own[i]), *row) for i, *row in kernel(ys, xs)]
                out.sort(key=lambda r: r[0])
                made = [head[i] | dict(zip(names[len(keys) :], row, strict=True)) for i, *row in out]
                if made:
                    yield pa.RecordBatch.from_pylist(made, made_schema)

    made_schema = to_arrow_schema(T.StructType.fromDDL(f"{kinds}, {schema}"))
    return rows.mapInArrow(run, f"{kinds}, {schema}")


def kalman_arx(df: DataFrame, keys: Keys, order: str, y: str, x: Keys, burn_in: int = 0, **how) -> DataFrame:
    """(keys, mean and sd of each parameter after ``burn_in`` samples, rmse of predictions). Segments no longer than that have
    no row."""

    def kernel(ys: np.ndarray, xs: np.ndarray) -> Iterator[tuple]:
        if ys.shape[1] > burn_in:
            path, ahead, _ = kalman(ys, xs, **how)
            kept, err = path[:, burn_in:], (ys - ahead)[:, burn_in:]
            yield from zip(range(len(ys)), kept.mean(1).tolist(), kept.std(1).tolist(), np.sqrt((err**2).mean(1)).tolist(), strict=True)

    return together(df, keys, order, y, x, "theta array<double>, theta_sd array<double>, rmse double", kernel)


def ar_fit(res: np.ndarray, order: int) -> np.ndarray:
    """(series, order) AR coefficients of each series, of the order that BIC chooses, 0 beyond it: one Levinson recursion
    gives all orders' fits from the autocovariances."""
    m, n = res.shape
    r = np.stack([(res[:, k:] * res[:, : n - k]).sum(1) / n for k in range(order + 1)], 1)
    a, err = np.zeros((m, order)), np.maximum(r[:, 0], 1e-300)
    best, least = a.copy(), n * np.log(err) + math.log(n)
    for k in range(1, order + 1):
        turn = (r[:, k] - np.einsum("mj,mj->m", a[:, : k - 1], r[:, k - 1 : 0 : -1])) / err
        a[:, : k - 1], a[:, k - 1] = a[:, : k - 1] - turn[:, None] * a[:, : k - 1][:, ::-1], turn
        err = np.maximum(err * (1 - turn * turn), 1e-300)
        bic = n * np.log(err) + (k + 1) * math.log(n)
        better = bic < least
        best[better], least = a[better], np.minimum(bic, least)
    return best


def whiten(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each series less what its AR model says of it; samples before the first are 0."""
    out = v.copy()
    for k in range(1, a.shape[1] + 1):
        out[:, k:] -= a[:, k - 1].reshape(-1, *[1] * (v.ndim - 1)) * v[:, :-k]
    return out


def weighted_fit(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(beta, inverse of the weighted products) of each series."""
    inverse = np.linalg.pinv(np.einsum("mnp,mn,mnq->mpq", x, w, x), hermitian=True)
    return np.einsum("mpq,mq->mp", inverse, np.einsum("mnp,mn->mp", x, w * y)), inverse


def ar_irls(y: np.ndarray, x: np.ndarray, order: int, rounds: int = 30) -> tuple[np.ndarray, ...]:
    """(beta, covariance, degrees of freedom, AR order): regression whose errors are autoregressive and have outliers; of one
    channel or, with a leading axis, of many of equal length together.

    Residuals' AR filter, its order up to ``order`` chosen by BIC, whitens both sides; a robust fit follows, until the
    estimates settle.
    """
    if y.ndim == 1:
        return tuple(v[0] for v in ar_irls(y[None], x[None], order, rounds))
    m, n, p = x.shape
    most = min(order, n // 4)
    beta, _ = weighted_fit(y, x, np.ones_like(y))
    w, yw, xw, a = np.ones_like(y), y.copy(), x.copy(), np.zeros((m, most))
    left = np.arange(m)
    for _ in range(rounds):
        a[left] = ar_fit(y[left] - np.einsum("mnp,mp->mn", x[left], beta[left]), most)
        yl, xl, b = whiten(y[left], a[left]), whiten(x[left], a[left]), beta[left]
        for _ in range(20):
            r = yl - np.einsum("mnp,mp->mn", xl, b)
            wl = biweight(r, np.median(r, axis=1, keepdims=True))
            last, (b, _) = b, weighted_fit(yl, xl, wl)
            if np.allclose(b, last, rtol=1e-8, atol=1e-12):
                break
        yw[left], xw[left], w[left] = yl, xl, wl
        moved = np.linalg.norm(b - beta[left], axis=1) > 1e-6 * np.maximum(np.linalg.norm(beta[left], axis=1), 1e-12)
        beta[left] = b
        left = left[moved]
        if not len(left):
            break
    dof = np.maximum(1, np.round(w.sum(1)).astype(np.int64) - p)
    r = yw - np.einsum("mnp,mp->mn", xw, beta)
    _, inverse = weighted_fit(yw, xw, w)
    return beta, ((w * r * r).sum(1) / dof)[:, None, None] * inverse, dof, (a != 0).sum(1)


def ar_irls_glm(df: DataFrame, keys: Keys, order: str, y: str, x: Keys, ar: int = 8) -> DataFrame:
    """(keys, term, beta, se, t, p, ar_order, status): :func:`ar_irls` for each channel, those of equal length together.

    A channel that can't be fitted has one row with a null term and the reason as its status.
    """

    def kernel(ys: np.ndarray, xs: np.ndarray) -> Iterator[tuple]:
        if ys.shape[1] <= len(x) + 2:
            yield from ((i, None, None, None, None, None, None, "too few rows") for i in range(len(ys)))
            return
        try:
            beta, cov, dof, used = ar_irls(ys, xs, ar)
        except np.linalg.LinAlgError as e:
            yield from ((i, None, None, None, None, None, None, str(e)) for i in range(len(ys)))
            return
        se = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
        t = np.divide(beta, se, out=np.full_like(beta, np.nan), where=se > 0)
        p = two_sided_p(t, np.broadcast_to(dof[:, None], t.shape))
        none = lambda v: None if math.isnan(v) else float(v)
        for i in range(len(ys)):
            for j, c in enumerate(x):
                yield i, c, float(beta[i, j]), float(se[i, j]), none(t[i, j]), none(p[i, j]), int(used[i]), "ok"

    return together(df, keys, order, y, x, "term string, beta double, se double, t double, p double, ar_order int, status string", kernel)
