"""Sufficient statistics and counts of a stream: windowed aggregates with late rows, and a running state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.suffstats import SuffStats, _merge, sufficient_stats


def windowed_moments(stream: DataFrame, time: str, x: str, y: str, width: str, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Count, means and covariance of two columns for each window; rows later than `late` are dropped."""
    keys = [F.window(time, width).alias("window"), *(by or [])]
    return (
        stream.withWatermark(time, late)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.covar_samp(x, y).alias("cov_xy"))
    )


def windowed_counts(stream: DataFrame, time: str, cols: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """A contingency table for each window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *cols).agg(F.count("*").alias("n"))


class RunningStats:
    """Statistics of all micro-batches so far, for `foreachBatch`; a batch that is repeated counts once."""

    def __init__(self, cols: list[str]) -> None:
        self.cols, self.stats, self.last = cols, None, -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        new = sufficient_stats(batch, self.cols)
        parts = [(s.n, s.means, s.cov * max(s.n - 1, 0)) for s in (self.stats, new) if s is not None and s.n]
        if parts:
            n, mean, m2 = parts[0] if len(parts) == 1 else _merge(*parts)
            self.stats = SuffStats(self.cols, n, m2 / max(n - 1, 1), mean)
        self.last = batch_id
