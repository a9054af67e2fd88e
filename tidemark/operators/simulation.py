"""Folds and simulations that need special functions at each step: one run or one period per task, seeded by its key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import lgamma, nb_cdf, normal_quantile


def reweighted_shares(panel: DataFrame, keep: float, shape: float, limit: float) -> DataFrame:
    """(score_run, period, cluster_id, n, memory_share, z): a decaying memory that counts surprising periods less.

    A count whose normal score z around the current expectation exceeds ``limit`` enters the memory with the expectation
    plus (limit / z) ** 2 of its excess. With an infinite limit this is the plain memory. A run's calendar is one fold; runs
    are independent.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="period", columns="cluster_id", values="n", aggfunc="sum", fill_value=0).sort_index()
        memory, out = np.zeros(wide.shape[1]), []
        for i, (period, y) in enumerate(zip(wide.index, wide.to_numpy(float))):
            share = (memory + 1) / (memory.sum() + len(memory))
            z, seen = np.full(len(y), np.nan), y
            if i and y.sum() > 0:
                mean = share * y.sum()
                middle = (nb_cdf(y - 1, shape, mean) + nb_cdf(y, shape, mean)) / 2
                z = normal_quantile(np.clip(middle, 1e-6, 1 - 1e-6))
                weight = np.where(z > limit, (limit / np.maximum(z, 1e-12)) ** 2, 1.0) if np.isfinite(limit) else np.ones(len(y))
                seen = np.where(weight < 1, mean + weight * (y - mean), y)
            memory = keep * memory + seen
            out += [(rows.score_run.iloc[0], period, c, int(n), s if i else None, None if v != v else v) for c, n, s, v in zip(wide.columns, y, share, z)]
        return pd.DataFrame(out, columns=["score_run", "period", "cluster_id", "n", "memory_share", "z"])

    return panel.select("score_run", "period", "cluster_id", "n").groupBy("score_run").applyInPandas(fold, "score_run long, period date, cluster_id long, n long, memory_share double, z double")


def _log_pmf(y: np.ndarray, a: np.ndarray) -> np.ndarray:
    n = y.sum(-1)
    return lgamma(a.sum()) - lgamma(n + a.sum()) + lgamma(n + 1) + (lgamma(y + a) - lgamma(a) - lgamma(y + 1)).sum(-1)


def rare_mixtures(panel: DataFrame, kappa: float, sims: int = 200, seed: int = 7) -> DataFrame:
    """(score_run, period, total, p_value): how often a Dirichlet-multinomial mixture around the shares ``share`` is as unlikely as the observed one.

    p = (1 + simulations with a log probability no larger) / (1 + simulations), drawn with a seed made of the keys, so
    that repeated runs agree. A period without counts has p 1.
    """

    def simulate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster_id")
        y, a = rows.n.to_numpy(float), kappa * rows.share.to_numpy(float)
        rng = np.random.default_rng([seed, int(key[0]), key[1].toordinal()])
        p = 1.0
        if y.sum() > 0:
            draws = rng.multinomial(int(y.sum()), rng.dirichlet(a, sims)).astype(float)
            p = (1 + int((_log_pmf(draws, a) <= _log_pmf(y, a) + 1e-12).sum())) / (1 + sims)
        return pd.DataFrame([(key[0], key[1], int(y.sum()), p)], columns=["score_run", "period", "total", "p_value"])

    return panel.where(F.col("share").isNotNull()).select("score_run", "period", "cluster_id", "n", "share").groupBy("score_run", "period").applyInPandas(simulate, "score_run long, period date, total long, p_value double")


def alarm_budget(per_month: float, period_days: float, series: int) -> float:
    """Alarms per decision when ``series`` series, decided on every ``period_days`` days, may give ``per_month`` false alarms a month together."""
    return per_month / (365.25 / 12 / period_days * series)


def _alarm_rate(z: np.ndarray, slack: float, limit: float) -> float:
    """Share of alarms among the steps of the upper cumulative sums of each row of ``z``, restarted after an alarm."""
    s, n = np.zeros(len(z)), 0
    for step in z.T:
        s = np.maximum(0, s + step - slack)
        over = s > limit
        n += int(over.sum())
        s[over] = 0
    return n / z.size


def cusum_limit(target: float, slack: float = 0.5, highest: float = 50.0, rounds: int = 30, paths: int = 2_000, steps: int = 520, seed: int = 7) -> float:
    """The least limit, to the bisection's precision, at which standard normal scores give at most ``target`` alarms per decision in seeded simulation."""
    z = np.random.default_rng(seed).standard_normal((paths, steps))
    low, high = 0.0, highest
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if _alarm_rate(z, slack, mid) <= target else (mid, high)
    return high


def empirical_limit(scored: DataFrame, by: list[str], at: str, z: str, target: float, slack: float = 0.5, highest: float = 50.0, points: int = 33, rounds: int = 4) -> float:
    """The same from observed scores: each round folds every series once for ``points`` limits at a time and narrows the interval; one number a limit comes to the driver."""
    rows = scored.select(*by, at, F.coalesce(z, F.lit(0.0)).cast("double").alias("_z"))

    def counted(grid: np.ndarray):
        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            s, n = np.zeros(len(grid)), np.zeros(len(grid), np.int64)
            for v in rows.sort_values(at)._z.to_numpy(float):
                s = np.maximum(0, s + v - slack)
                n += s > grid
                s[s > grid] = 0
            return pd.DataFrame({"i": np.arange(len(grid)), "alarms": n, "steps": len(rows)})

        return fold

    low, high = 0.0, highest
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        got = rows.groupBy(*by).applyInPandas(counted(grid), "i int, alarms long, steps long").groupBy("i").agg((F.sum("alarms") / F.sum("steps")).alias("rate")).toPandas()
        if got.empty:
            return 0.0
        rate = got.set_index("i").rate.reindex(range(points)).to_numpy()
        first = int(np.argmax(rate <= target)) if (rate <= target).any() else points - 1
        low, high = grid[max(0, first - 1)], grid[first]
    return float(high)


def nb_draws(rows: DataFrame, keys: list[str], mean: str, shape: float, draws: int, seed: int = 7) -> DataFrame:
    """``keys`` with ``draw`` and ``value``: seeded negative-binomial draws (a Poisson whose rate is gamma-distributed) around ``mean``; an infinite shape gives Poisson draws. Rows with a null or non-positive mean draw zeros."""
    held = rows.select(*keys, F.col(mean).cast("double").alias("_mean"), F.xxhash64(*keys).alias("_h"))
    kinds = dict(held.dtypes)

    def run(batches):
        for b in batches:
            out = []
            for h, m in zip(b._h, b._mean):
                rng = np.random.default_rng([seed, int(h) & 0xFFFFFFFFFFFF])
                m = 0.0 if m is None or not m > 0 else m
                rate = np.full(draws, m) if np.isinf(shape) or m == 0 else rng.gamma(shape, m / shape, draws)
                out.append(rng.poisson(rate))
            yield b.loc[b.index.repeat(draws), keys].assign(draw=np.tile(np.arange(draws), len(b)), value=np.concatenate(out) if out else np.zeros(0, int))

    return held.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", draw int, value long")
