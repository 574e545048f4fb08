"""Signals: look-ahead-safe functions of a catalog, as long tables ticker, pos, day, value."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.moments import bias_corrected_skewness
from gridloom.operators.panel import dollar_volume, guarded, lagged, log_positive, returns, trailing
from gridloom.sources.catalog import Catalog

KEYS = ["ticker", "pos", "day"]


class Factor(ABC):
    """A named signal; direction +1 or -1 says which end is expected to do better."""

    def __init__(self, name: str, direction: int = 1) -> None:
        self.name, self.direction = name, direction

    @abstractmethod
    def panel(self, catalog: Catalog) -> DataFrame:
        """ticker, pos, day, value (raw)."""

    def on(self, catalog: Catalog, day: int) -> DataFrame:
        """ticker, value on the last panel day at or before ``day``."""
        rows = self.panel(catalog)
        last = rows.where(F.col("day") <= day).agg(F.max("day").alias("d")).first()["d"]
        return rows.where(F.col("day") == (last if last is not None else -(2**31))).where("value is not null").select("ticker", "value")

    def signal_column(self) -> str:
        return f"_signal_{self.name}"

    def add(self, catalog: Catalog, rows: DataFrame) -> DataFrame:
        """rows (ticker, pos, day, close, adj, volume, ...) with the raw signal as column signal_column()."""
        own = self.panel(catalog).select("ticker", "pos", F.col("value").alias(self.signal_column()))
        return rows.join(own, ["ticker", "pos"], "left")

    def oriented(self, catalog: Catalog, days: DataFrame | None = None) -> DataFrame:
        """The panel times direction, on the given days; the restriction comes after all windows."""
        rows = self.panel(catalog).withColumn("value", F.col("value") * self.direction)
        return rows if days is None else rows.join(days.select("day").distinct(), "day", "left_semi")

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.name!r}, {self.direction:+d})"


class Expression(Factor):
    """A factor given as columns over the catalog's panel, so that any number of them shares one panel and its exchange.

    ``steps`` maps (catalog, rows) to rows with a column ``value`` and every column they had.
    """

    def __init__(self, name: str, direction: int, steps: Callable[[Catalog, DataFrame], DataFrame]) -> None:
        super().__init__(name, direction)
        self.steps = steps

    def panel(self, catalog: Catalog) -> DataFrame:
        return self.steps(catalog, catalog.panel).select(*KEYS, "value")

    def add(self, catalog: Catalog, rows: DataFrame) -> DataFrame:
        done = self.steps(catalog, rows)
        return done.select(*rows.columns, F.col("value").alias(self.signal_column()))


class Stored(Factor):
    """A panel that exists already, as a factor."""

    def __init__(self, rows: DataFrame, name: str, direction: int = 1) -> None:
        if not isinstance(rows, DataFrame):
            raise TypeError("a stored panel must be a DataFrame")
        super().__init__(name, direction)
        self.rows = rows

    def panel(self, catalog: Catalog) -> DataFrame:
        return self.rows


class Registry:
    """Factors by name, in order of registration; the first of a name stays."""

    def __init__(self) -> None:
        self._known: dict[str, Factor] = {}

    def register(self, factor: Factor) -> Factor:
        return self._known.setdefault(factor.name, factor)

    def get(self, name: str) -> Factor:
        return self._known[name]

    def all(self) -> list[Factor]:
        return list(self._known.values())


def momentum(panel: DataFrame, lookback: int, skip: int, log_prices: bool = False) -> DataFrame:
    """panel with value: ln P skip rows earlier - ln P lookback rows earlier; NULL without that much history."""
    p = F.col("adj") if log_prices else log_positive("adj")
    return panel.withColumn("value", lagged(p, skip) - lagged(p, lookback))


def momentum_on(catalog: Catalog, day: int, lookback: int = 252, skip: int = 21, members: DataFrame | None = None) -> DataFrame:
    """ticker, value: momentum on the last calendar day at or before ``day``, of the members (ticker) if given.

    Fewer than ``lookback`` + 1 calendar days up to then: ValueError.
    """
    at = catalog.days.where(F.col("day") <= day).agg(F.max("pos").alias("p")).first()["p"]
    if at is None or at < lookback:
        raise ValueError(f"momentum needs {lookback + 1} days up to the day")
    out = momentum(catalog.panel, lookback, skip).where((F.col("pos") == at) & F.col("value").isNotNull()).select("ticker", "value")
    return out if members is None else out.join(members.select("ticker").distinct(), "ticker", "left_semi")


def reversal(panel: DataFrame, window: int = 21) -> DataFrame:
    return momentum(panel, window, 0)


def volatility(rets: DataFrame, window: int = 60, least: int = 40) -> DataFrame:
    """rets with value: sample deviation of returns over the trailing window."""
    return rets.withColumn("value", guarded(F.stddev_samp("ret"), "ret", window, least))


def illiquidity(rets: DataFrame, window: int = 21, least: int = 14) -> DataFrame:
    """rets with value: mean of |return| per dollar of volume, times 1e6; days without volume are left out."""
    daily = rets.withColumn("_x", F.try_divide(F.abs("ret"), F.nullif(dollar_volume(), F.lit(0.0))))
    return daily.withColumn("value", guarded(F.avg("_x"), "_x", window, least) * 1e6)


def residual_skewness(rets: DataFrame, market: DataFrame, window: int = 60, least: int = 40) -> DataFrame:
    """rets with value: bias-corrected skewness of the residuals of rolling market betas (covariance pairwise, variance of the market alone); NULL where the residuals don't vary."""
    m = rets.join(F.broadcast(market), "day", "left")  # one row a day
    w = trailing(window)
    pairs = F.count(F.when(F.col("ret").isNotNull() & F.col("market").isNotNull(), 1)).over(w)
    cov = F.when(pairs >= least, F.covar_samp("ret", "market").over(w))
    var = F.when(F.count("market").over(w) >= least, F.var_samp("market").over(w))
    residual = m.withColumn("_e", F.col("ret") - F.try_divide(cov, var) * F.col("market"))
    n = F.count("_e").over(w)
    moves = F.stddev_pop("_e").over(w) > 1e-12  # below that the residuals are rounding noise
    return residual.withColumn("value", F.when((n >= least) & moves, bias_corrected_skewness(F.skewness("_e").over(w), n)))


def size(capped: DataFrame) -> DataFrame:
    return capped.withColumn("value", log_positive("cap"))


def ratio_to_cap(capped: DataFrame) -> DataFrame:
    """capped with value: known / cap; a cap of 0 gives NULL."""
    return capped.withColumn("value", F.try_divide("known", F.nullif("cap", F.lit(0.0))))


def _quality(c: Catalog, rows: DataFrame) -> DataFrame:
    both = c.known("total_assets", c.known("gross_profit", rows).withColumnRenamed("known", "_gross"))
    return both.withColumn("value", F.try_divide("_gross", F.nullif("known", F.lit(0.0))))


FACTORS = Registry()
for _f in (
    Expression("momentum_12_1", 1, lambda c, rows: momentum(rows, 252, 21)),
    Expression("reversal_1m", -1, lambda c, rows: reversal(rows, 21)),
    Expression("volatility_60", -1, lambda c, rows: volatility(returns(rows, "log"))),
    Expression("amihud_illiquidity", 1, lambda c, rows: illiquidity(returns(rows, "simple"))),
    Expression("idiosyncratic_skew", -1, lambda c, rows: residual_skewness(returns(rows, "log"), c.market)),
    Expression("size", -1, lambda c, rows: size(c.capped(rows))),
    Expression("value", 1, lambda c, rows: ratio_to_cap(c.known("book_equity", c.capped(rows)))),
    Expression("quality", 1, _quality),
):
    FACTORS.register(_f)


def rolling_volatility(panel: DataFrame, window: int = 63) -> DataFrame:
    """ticker, pos, day, value: sample deviation of simple returns; at least max(2, window // 4) of them."""
    return volatility(returns(panel, "simple"), window, max(2, window // 4)).select(*KEYS, "value")
