"""Seeded bootstrap intervals: resampling needs NumPy's bit streams, hence a grouped UDF."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20_260_824
REPLICATES = 10_000


def interval(values: np.ndarray, name: str, seed: int = SEED, replicates: int = REPLICATES) -> tuple[float, float, float, float]:
    """95 % percentile intervals of mean and median; the stream depends on seed and name."""
    words = np.frombuffer(hashlib.sha256(name.encode()).digest()[:16], "<u4").tolist()
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, *words])))
    means, medians = np.empty(replicates), np.empty(replicates)
    block = max(1, 4_000_000 // max(1, len(values)))
    for at in range(0, replicates, block):
        rows = min(block, replicates - at)
        drawn = values[rng.integers(0, len(values), size=(rows, len(values)))]
        means[at : at + rows] = drawn.mean(axis=1)
        medians[at : at + rows] = np.median(drawn, axis=1)
    return (*np.quantile(means, [0.025, 0.975]), *np.quantile(medians, [0.025, 0.975]))


def bootstrap_intervals(df: DataFrame, *, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per key the intervals of mean and median.  Values are taken in ``order``, since the
    resampled places depend on it.  A group holds summary values (one per compared unit), so
    it fits a task; missing values are left out."""
    types = dict(df.dtypes)
    schema = ", ".join(
        [*[f"{k} {types[k]}" for k in keys], "mean_ci_low double, mean_ci_high double, median_ci_low double, median_ci_high double"]
    )

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(list(order))[value].dropna().to_numpy(float)
        if not len(values):
            return pd.DataFrame([[*key, None, None, None, None]])
        return pd.DataFrame([[*key, *interval(values, "|".join(map(str, key)))]])

    return df.select(*keys, *[c for c in order if c not in keys], F.col(value)).groupBy(*keys).applyInPandas(run, schema)
