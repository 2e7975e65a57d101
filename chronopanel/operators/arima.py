"""ARIMA-type models by two regressions (Hannan-Rissanen).

A long autoregression gives innovations; a second regression on lags of the
differenced series and of the innovations gives the model.  Seasonal and plain
polynomials multiply: the lags k, m j and m j + k carry the coefficients phi_k,
PHI_j and -phi_k PHI_j.  The sum of squares is a quadratic form in these, so the
product models are fitted by Gauss-Newton steps on one Gram matrix per series;
all candidate orders are sub-blocks of it, so the stepwise order search, whose
frontiers are fitted in batches of series, costs one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators import features
from chronopanel.operators.decompose import classical
from chronopanel.operators.regression import fit_ols, fit_seasonal, gram_sums, unpack
from chronopanel.operators.stl import stl
from chronopanel.operators.windows import framed
from chronopanel.panel import Panel, shift


@dataclass(frozen=True)
class Orders:
    """The search space: highest orders, or one fixed model when ``fixed`` is set."""

    p: int = 3
    q: int = 3
    P: int = 1
    Q: int = 1
    d: int | None = None
    D: int | None = None
    constant: bool | None = None
    fixed: bool = False
    long_ar: int = 10
    stepwise: bool = True
    loess_season: bool = False  # the seasonal strength comes from STL, not from season means

    def nonseasonal(self) -> Orders:
        return replace(self, P=0, Q=0, D=0)

    def candidates(self) -> list[tuple[int, int, int, int, int]]:
        """(p, q, P, Q, constant) of every candidate."""
        if self.fixed:
            consts = [1, 0] if self.constant is None else [int(self.constant)]
            return [(self.p, self.q, self.P, self.Q, c) for c in consts]
        consts = [1, 0] if self.constant is None else [int(self.constant)]
        return list(product(range(self.p + 1), range(self.q + 1), range(self.P + 1), range(self.Q + 1), consts))

    def first_round(self) -> list[tuple[int, int, int, int, int]]:
        """The models that a stepwise search begins with: large, empty, autoregressive and moving average, as the limits allow."""
        starts = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
        clipped = [tuple(min(x, most) for x, most in zip(s, (self.p, self.q, self.P, self.Q))) for s in starts]
        return [c for c in self.candidates() if c[:4] in clipped]

    def neighbours(self, cand: tuple[int, int, int, int, int]) -> list[tuple[int, int, int, int, int]]:
        """Candidates one step away: one order, both plain or both seasonal orders, or the constant."""
        p, q, P, Q, c = cand
        steps = [(1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 1, 1)]
        near = {(p + s * a, q + s * b, P + s * x, Q + s * y, c) for a, b, x, y in steps for s in (1, -1)} | {(p, q, P, Q, 1 - c)}
        return [x for x in self.candidates() if x in near]


def fixed_order(
    pdq: tuple[int, int, int], PDQ: tuple[int, int, int] = (0, 0, 0), constant: bool | None = None
) -> Orders:
    (p, d, q), (P, D, Q) = pdq, PDQ
    return Orders(p, q, P, Q, d, D, constant, fixed=True, stepwise=False)


def with_differencing(panel: Panel, y: str, orders: Orders, m: int) -> Panel:
    """Adds the difference orders ``order_d`` and (seasonal) ``order_ds`` of each series as columns."""
    key = list(panel.key)
    df = panel.df
    if orders.D is not None or m <= 1:
        df = df.withColumn("order_ds", F.lit(orders.D or 0).cast("long"))
    else:
        if orders.loess_season:
            strong = features.seasonal_strength(stl(panel, y, periods=(m,)), "seasonal", "remainder")
        else:
            strong = features.seasonal_strength(classical(panel, y, period=m), "seasonal", "random")
        table = features.nsdiffs(strong, key).withColumnRenamed("nsdiffs", "order_ds")
        df = df.join(table, key, "left").fillna(0, subset=["order_ds"])
    if orders.d is not None:
        return panel.on(df.withColumn("order_d", F.lit(orders.d).cast("long")))
    p = framed(panel.on(df), {"__s": lambda w: F.col(y) - F.lag(y, m).over(w)}, m)
    stable = p.on(p.df.withColumn("__s", F.when(F.col("order_ds") == 1, F.col("__s")).otherwise(F.col(y))))
    table = features.ndiffs(stable.on(stable.df.where("__s is not null")), "__s")
    return panel.on(df.join(table.withColumnRenamed("ndiffs", "order_d"), key, "left").fillna(0, subset=["order_d"]))


def design(panel: Panel, y: str, orders: Orders, m: int) -> Panel:
    """Differenced series ``w``, innovations ``e`` and all candidate lag columns.

    Expects ``order_d`` and ``order_ds``.
    """
    key, v = list(panel.key), F.col(y).cast("double")
    p = panel.with_position("t")
    # Nested differences up to the highest order that any series may have; each series takes its own.
    p = p.on(p.df.withColumn("w", v))
    most_s = orders.D if orders.D is not None else 1
    for k in range(1, most_s + 1 if m > 1 else 1):
        p = framed(p, {"__next": lambda w: F.col("w") - F.lag("w", m).over(w)}, m)
        p = p.on(p.df.withColumn("w", F.when(F.col("order_ds") >= k, F.col("__next")).otherwise(F.col("w"))).drop("__next"))
    most = orders.d if orders.d is not None else 2
    for k in range(1, most + 1):
        p = framed(p, {"__next": lambda w: F.col("w") - F.lag("w").over(w)}, 1)
        p = p.on(p.df.withColumn("w", F.when(F.col("order_d") >= k, F.col("__next")).otherwise(F.col("w"))).drop("__next"))
    # Innovations for a seasonal part need the lags around one and two periods.
    long_lags = [*range(1, orders.long_ar + 1)] if orders.q + orders.Q else []
    if orders.Q:
        long_lags = sorted({*long_lags, *range(m, m + orders.long_ar + 1), 2 * m})
    ar = [f"__a{k}" for k in long_lags]
    w_lags = lag_columns("w", orders.p, orders.P, m)
    lags = dict(zip(ar, long_lags)) | w_lags
    if not lags:
        return p
    p = framed(p, {n: (lambda win, k=k: F.lag("w", k).over(win)) for n, k in lags.items()}, max(lags.values()))
    if not orders.q + orders.Q:
        # A pure AR model needs no innovations.
        return p.on(p.df.drop(*ar))
    long_fit = fit_ols(p.df, key, "w", ar).select(*key, F.col("coef").alias("__b"))
    df = p.df.join(long_fit, key, "left")
    fitted = F.col("__b")[0]
    for i, a in enumerate(ar):
        fitted = fitted + F.col("__b")[i + 1] * F.col(a)
    p = p.on(df.withColumn("e", F.col("w") - fitted).drop("__b", *ar))
    e_lags = lag_columns("e", orders.q, orders.Q, m)
    if e_lags:
        p = framed(p, {n: (lambda win, k=k: F.lag("e", k).over(win)) for n, k in e_lags.items()}, max(e_lags.values()))
    return p


def lag_columns(name: str, short: int, seasonal: int, m: int) -> dict[str, int]:
    """Columns of the plain, seasonal and product lags, in the order of the coefficients."""
    plain = {f"{name}{k}": k for k in range(1, short + 1)}
    yearly = {f"{name}S{j}": j * m for j in range(1, seasonal + 1)}
    return plain | yearly | {f"{name}X{j}_{k}": j * m + k for j in range(1, seasonal + 1) for k in range(1, short + 1)}


def _columns(orders: Orders) -> list[str]:
    return [*lag_columns("w", orders.p, orders.P, 1), *lag_columns("e", orders.q, orders.Q, 1)]


class Product:
    """One candidate: its free coefficients as positions, and how they make up all columns' coefficients."""

    def __init__(self, orders: Orders, cand: tuple[int, int, int, int, int]):
        p, q, P, Q, constant = cand
        self.size = 1 + len(_columns(orders))
        self.free, self.crosses = [0] if constant else [], []
        at = 1
        for short, seasonal, most, most_seasonal, sign in ((p, P, orders.p, orders.P, -1), (q, Q, orders.q, orders.Q, 1)):
            self.free += [at + k for k in range(short)] + [at + most + j for j in range(seasonal)]
            base = at + most + most_seasonal
            self.crosses += [(base + j * most + k, at + k, at + most + j, sign) for j in range(seasonal) for k in range(short)]
            at = base + most * most_seasonal

    def expanded(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All coefficients, and their derivatives by the free ones."""
        full, slope = np.zeros(self.size), np.zeros((self.size, len(self.free)))
        full[self.free] = beta
        slope[self.free, range(len(self.free))] = 1
        place = {c: i for i, c in enumerate(self.free)}
        for cross, a, b, sign in self.crosses:
            full[cross] = sign * full[a] * full[b]
            slope[cross, place[a]], slope[cross, place[b]] = sign * full[b], sign * full[a]
        return full, slope

    def fit(self, gram: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float, int]:
        """Coefficients of all columns, sum of squares and rank, from the products with y last."""
        inner, side, total = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
        scale = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))

        def steps(matrix: np.ndarray, target: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, int]:
            out, _, rank, _ = np.linalg.lstsq(matrix * by[:, None] * by[None, :], target * by, rcond=1e-9)
            return out * by, int(rank)

        def loss(full: np.ndarray) -> float:
            return float(total - 2 * full @ side + full @ inner @ full)

        if not self.free:
            return np.zeros(self.size), float(total), 0
        beta, rank = steps(inner[np.ix_(self.free, self.free)], side[self.free], scale[self.free])
        full, slope = self.expanded(beta)
        best = loss(full)
        for _ in range(rounds if self.crosses else 0):
            move, rank = steps(slope.T @ inner @ slope, slope.T @ (side - inner @ full), scale[self.free])
            for _ in range(12):
                new, new_slope = self.expanded(beta + move)
                if loss(new) <= best:
                    break
                move = move / 2
            else:
                break
            gain, beta, full, slope, best = best - loss(new), beta + move, new, new_slope, loss(new)
            if gain <= 1e-12 * max(abs(total), 1e-300):
                break
        return full, max(best, 0.0), rank

    def unit_variances(self, gram: np.ndarray, full: np.ndarray) -> list[float | None]:
        """Variances of the free coefficients for a residual variance of 1, from the Gauss-Newton products; None for the others."""
        slope = self.expanded(full[self.free])[1]
        inner = np.linalg.pinv(slope.T @ gram[:-1, :-1] @ slope, rcond=1e-13, hermitian=True) if self.free else np.zeros((0, 0))
        out: list[float | None] = [None] * self.size
        for i, place in enumerate(self.free):
            out[place] = float(inner[i, i])
        return out


def criterion(n, rss, rank):
    """AICc of a fit; a model with too many coefficients for its rows has none."""
    if n <= rank + 2:
        return float("inf")
    return n * np.log(max(rss, 1e-12) / n) + 2 * (rank + 1) + 2 * (rank + 1) * (rank + 2) / (n - rank - 2)


def searched(orders: Orders, fit, allowed) -> dict:
    """Fits of the candidates that the search meets, by candidate; ``fit`` gives (coefficients, rss, rank, AICc).

    A frontier of candidates is fitted round by round: first the starting models,
    then the neighbours of the best so far, until no neighbour is better.
    """
    if not orders.stepwise:
        return {c: fit(c) for c in orders.candidates() if allowed(c)}
    fits, frontier, best = {}, orders.first_round(), None
    while frontier:
        fits |= {c: fit(c) for c in frontier if allowed(c)}
        leader = min(fits, key=lambda c: (fits[c][3], c), default=None)
        if leader is None or leader == best:
            break
        best = leader
        frontier = [c for c in orders.neighbours(best) if c not in fits]
    return fits


def product_solver(orders: Orders):
    """UDF: a Gram array, its number of rows and the differences -> fits of the searched candidates, by their number."""
    candidates = orders.candidates()
    models, k = {c: Product(orders, c) for c in candidates}, 1 + len(_columns(orders))
    number = {c: i for i, c in enumerate(candidates)}

    @F.pandas_udf("array<struct<i:int,coef:array<double>,rss:double,rank:int,unit:array<double>>>")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for grams, ns, differences in batches:
            rows = []
            for gram, n, d in zip(unpack(grams, k + 1) if len(grams) else (), ns, differences):

                def fit(cand, gram=gram, n=n):
                    full, rss, rank = models[cand].fit(gram)
                    return full, rss, rank, criterion(n, rss, rank)

                # A constant beside two differences would be a quadratic trend.
                fits = searched(orders, fit, lambda c, d=d: c[4] == 0 or d < 2 or orders.constant is True)
                rows.append([{"i": number[c], "coef": full.tolist(), "rss": rss, "rank": rank, "unit": models[c].unit_variances(gram, full)} for c, (full, rss, rank, _) in sorted(fits.items())])
            yield pd.Series(rows, dtype=object)

    return solve


def select_model(designed: Panel, orders: Orders) -> DataFrame:
    """Best candidate by AICc: orders, coefficients (constant first), sigma2, aicc."""
    key, names = list(designed.key), _columns(orders)
    cols = [F.col(c) for c in ["w", *names]]
    full = cols[0].isNotNull()
    for c in cols[1:]:
        full = full & c.isNotNull()
    gram = gram_sums([F.lit(1.0), *cols[1:], cols[0]])
    sums = designed.df.where(full).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), gram.alias("g"), F.first("order_d").alias("order_d"), F.first("order_ds").alias("order_ds")
    )
    cands = orders.candidates()
    solve = product_solver(orders)
    table = F.lit([list(c) for c in cands])
    out = sums.withColumn("f", solve("g", "n", F.col("order_d") + F.col("order_ds"))).select(*key, "n", "order_d", "order_ds", F.explode("f").alias("f"))
    out = out.select(*key, "n", "order_d", "order_ds", F.get(table, F.col("f.i")).alias("o"), "f.coef", "f.rss", "f.rank", "f.unit")
    n, k = F.col("n"), F.col("rank")
    aicc = n * F.log(F.greatest("rss", F.lit(1e-12)) / n) + 2 * (k + 1) + F.try_divide(2 * (k + 1) * (k + 2), n - k - 2)
    out = out.withColumn("aicc", aicc)
    out = out.where(n > k + 2)
    pick = F.struct(
        "n", "order_d", "order_ds",
        *[F.col("o")[i].cast("long").alias(c) for i, c in enumerate(["order_p", "order_q", "order_ps", "order_qs", "constant"])],
        "coef", F.try_divide("rss", n - k).alias("sigma2"), "rank", "rss", "aicc", "unit",
    )
    best = out.groupBy(*key).agg(F.min_by(pick, F.struct("aicc", "o")).alias("b"))
    return best.select(*key, "b.*")


def fit_arima(panel: Panel, y: str, orders: Orders = Orders(), period: int | None = None):
    """Fit one model per series.  Returns (models, designed panel with ``innov``)."""
    m = period or panel.period
    # Order tests read the series several times and the order search reads the
    # lag columns several times, so each is stored once.
    p = panel.on(panel.df.select(*panel.key, panel.index, y))
    tested = orders.d is None or (orders.D is None and m > 1)
    p = with_differencing(p.written("series") if tested else p, y, orders, m)
    if tested:
        p = p.written("orders")
    p = design(p, y, orders, m).written("lags")
    models = select_model(p, orders)
    df = p.df.join(models.select(*panel.key, F.col("coef").alias("__c")), list(panel.key), "left")
    fitted = F.col("__c")[0]
    for i, name in enumerate(_columns(orders)):
        term = F.col("__c")[i + 1]
        fitted = fitted + F.when(term == 0, F.lit(0.0)).otherwise(term * F.col(name))
    df = df.withColumn("innov", F.col("w") - fitted).drop("__c")
    return models, p.on(df)


def glance_arima(models: DataFrame, key: Sequence[str]) -> DataFrame:
    """n, orders, sigma2, log_lik, aic, aicc, bic of fitted models; criteria as those of the regressions."""
    n, k = F.col("n"), F.col("rank")
    logs = n * F.log(F.greatest("rss", F.lit(1e-12)) / n)
    return models.select(
        *key, "n", "order_p", "order_d", "order_q", "order_ps", "order_ds", "order_qs", "sigma2", (-(n * (math.log(2 * math.pi) + 1) + logs) / 2).alias("log_lik"),
        (logs + 2 * (k + 1)).alias("aic"), "aicc", (logs + (k + 1) * F.log(n)).alias("bic"),
    )


def tidy_arima(models: DataFrame, key: Sequence[str], orders: Orders) -> DataFrame:
    """Coefficient table of fitted models: term, estimate, std_error, statistic; product lags follow from the others and have no row."""
    kinds = {"w": "ar", "wS": "sar", "e": "ma", "eS": "sma"}
    names = ["constant"]
    for c in _columns(orders):
        letters = c.rstrip("0123456789")
        names.append(kinds.get(letters, "") + c[len(letters) :] if letters in kinds else "")
    cells = F.posexplode(F.arrays_zip("coef", "unit"))
    out = models.select(*key, "sigma2", cells.alias("i", "c")).where("c.unit IS NOT NULL")
    out = out.select(*key, F.get(F.lit(names), F.col("i")).alias("term"), F.col("c.coef").alias("estimate"), F.sqrt(F.col("sigma2") * F.col("c.unit")).alias("std_error"))
    return out.withColumn("statistic", F.try_divide("estimate", "std_error"))


FORECAST = "struct<mean:array<double>,sd:array<double>>"


def _roller(orders: Orders, m: int):
    """UDF: model row, horizon and tails of y and innovations -> forecast arrays."""

    @F.pandas_udf(FORECAST)
    def roll(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for coefs, ds, Ds, s2s, hs, tails, etails in batches:
            means, sds = [], []
            for coef, d, D, s2, h, yt, et in zip(coefs, ds, Ds, s2s, hs, tails, etails):
                coef, yt, et = np.asarray(coef, float), np.asarray(yt, float), np.asarray(et, float)
                ar = np.zeros(orders.p + m * orders.P + 1)
                ma = np.zeros(orders.q + m * orders.Q + 1)
                ar[0] = ma[0] = 1.0
                pos = 1
                for lag in lag_columns("w", orders.p, orders.P, m).values():
                    ar[lag] -= coef[pos]
                    pos += 1
                for lag in lag_columns("e", orders.q, orders.Q, m).values():
                    ma[lag] += coef[pos]
                    pos += 1
                for _ in range(int(d)):
                    ar = np.convolve(ar, [1.0, -1.0])
                for _ in range(int(D)):
                    ar = np.convolve(ar, np.concatenate([[1.0], np.zeros(m - 1), [-1.0]]))
                need = len(ar) - 1
                if len(yt) < need or np.isnan(yt[len(yt) - need :]).any():
                    means.append([np.nan] * h)
                    sds.append([np.nan] * h)
                    continue
                level = np.concatenate([yt, np.zeros(h)])
                shock = np.concatenate([np.zeros(max(0, len(ma) - len(et))), np.nan_to_num(et), np.zeros(h)])
                psi = np.zeros(h)
                base, sb = len(yt), len(shock) - h
                for i in range(h):
                    past = level[base + i - need : base + i][::-1] if need else np.zeros(0)
                    noise = shock[sb + i - len(ma) + 1 : sb + i][::-1]
                    level[base + i] = coef[0] - ar[1:] @ past + ma[1:] @ noise
                    theta = ma[i] if i < len(ma) else 0.0
                    back = min(i, need)
                    psi[i] = theta - (ar[1 : back + 1] @ psi[i - back : i][::-1] if back else 0.0)
                means.append(level[base:].tolist())
                sds.append(np.sqrt(max(s2, 0.0) * np.cumsum(psi**2)).tolist())
            yield pd.DataFrame({"mean": means, "sd": sds})

    return roll


def forecast_arima(
    models: DataFrame, designed: Panel, y: str, h: int | DataFrame, orders: Orders = Orders(), period: int | None = None
) -> DataFrame:
    """Forecast table (key, h, index, mean, sd) from the last rows of each series.

    ``h`` is one horizon for all, or a table with the key and each series' ``horizon``.
    """
    m = period or designed.period
    key = list(designed.key)
    most_d, most_ds = 2 if orders.d is None else orders.d, 1 if orders.D is None else orders.D
    keep = max(orders.p + m * orders.P, orders.q + m * orders.Q) + most_d + m * most_ds + 1
    n = F.max("t").over(designed.whole())
    last = designed.df.withColumn("__n", n).where(F.col("t") > F.col("__n") - keep)
    row = F.struct("t", F.col(y).cast("double").alias("y"), "innov")
    tails = last.groupBy(*key).agg(
        F.array_sort(F.collect_list(row)).alias("__r"), F.max(designed.index).alias("__end")
    )
    df = models.join(tails, key)
    df = df.withColumn("horizon", F.lit(h)) if isinstance(h, int) else df.join(h.select(*key, "horizon"), key)
    cells = _roller(orders, m)("coef", "order_d", "order_ds", "sigma2", "horizon", F.col("__r.y"), F.col("__r.innov"))
    df = df.withColumn("__f", cells)
    out = df.select(*key, "__end", F.posexplode(F.arrays_zip("__f.mean", "__f.sd")).alias("h", "c"))
    return out.select(
        *key,
        (F.col("h") + 1).cast("long").alias("h"),
        shift("__end", F.col("h") + 1, designed.grain).alias(designed.index),
        F.nanvl("c.mean", F.lit(None)).alias("mean"),
        F.nanvl("c.sd", F.lit(None)).alias("sd"),
    )


def horizons(split: Panel) -> DataFrame:
    """The last test step of every series of a split."""
    tests = split.df.where("part = 'test'")
    return tests.groupBy(*split.key).agg(F.max("h").cast("int").alias("horizon"))


def arima_regression(
    split: Panel, y: str, xs: Sequence[str], orders: Orders, season: str = "season", period: int | None = None, residuals: bool = False
) -> DataFrame:
    """Seasonal regression with ARMA errors, forecast on all test rows of a split.

    Ordinary fit, ARMA orders of its residuals, one refit of the slopes on
    columns filtered with the AR part, and the error forecast added on top.  With
    ``residuals`` the innovations of the training rows instead: (key, index, resid).
    """
    m = period or split.period
    key = list(split.key)
    rows = split.df
    train = split.on(rows.where("part = 'train'").drop("h"))
    by_season = Window.partitionBy(*key, season)
    centred = {f"__z{i}": F.col(c) - F.avg(c).over(by_season) for i, c in enumerate([y, *xs])}
    first = fit_seasonal(train.df, key, y, xs, season)
    own = train.df.withColumns(centred).join(first.select(*key, season, "coef"), [*key, season], "left")

    def rest(coef: str) -> Column:
        out = F.col("__z0")
        for i in range(len(xs)):
            out = out - F.col(coef)[i] * F.col(f"__z{i + 1}")
        return out

    resid = train.on(own.withColumn("__u", rest("coef")).drop("coef")).written("residuals")
    arma = replace(orders, d=0, D=0, constant=False)
    models, _ = fit_arima(resid.on(resid.df.select(*key, split.index, "__u")), "__u", arma, m)
    # Plain, seasonal and product lags of the autoregressive part.
    lags = list(lag_columns("w", arma.p, arma.P, m).values())
    phi = models.select(*key, F.slice("coef", 2, len(lags)).alias("__phi"))
    filtered = resid.on(resid.df.join(phi, key))

    def quasi(col: str):
        def expr(w):
            out = F.col(col)
            for i, k in enumerate(lags):
                weight = F.col("__phi")[i]
                # A lag that the model does not use costs no rows.
                out = out - F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.lag(col, k).over(w))
            return out

        return expr

    names = [f"__q{i}" for i in range(len(xs) + 1)]
    filtered = framed(filtered, {n: quasi(f"__z{i}") for i, n in enumerate(names)}, max([1, *lags]))
    second = fit_ols(filtered.df, key, "__q0", names[1:], intercept=False).select(*key, F.col("coef").alias("beta"))
    refit = resid.on(resid.df.join(second, key).withColumn("__v", rest("beta")))
    models, designed = fit_arima(refit.on(refit.df.select(*key, split.index, "__v")), "__v", arma, m)
    if residuals:
        return designed.df.select(*key, split.index, F.col("innov").alias("resid"))
    noise = forecast_arima(models, designed, "__v", horizons(split), arma, m).select(*key, "h", F.col("mean").alias("__e"), "sd")
    means = train.df.groupBy(*key, season).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate([y, *xs])])
    out = rows.where("part = 'test'").join(means, [*key, season], "left").join(second, key, "left")
    value = F.col("__m0")
    for i, c in enumerate(xs):
        value = value + F.col("beta")[i] * (F.col(c) - F.col(f"__m{i + 1}"))
    out = out.withColumn("__reg", value).join(noise, [*key, "h"], "left")
    return out.select(
        *key, "h", split.index, F.col(y).cast("double").alias("actual"), (F.col("__reg") + F.col("__e")).alias("mean"), "sd"
    )
