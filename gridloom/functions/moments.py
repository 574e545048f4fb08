"""Sample moments that the engine's population ones are converted to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bias_corrected_skewness(g1: Column, n: Column) -> Column:
    """G1 from the population skewness; NULL below three values."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def bias_corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Excess kurtosis G2 from the population one; NULL below four values."""
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation of pairs with both present; NULL where a side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
