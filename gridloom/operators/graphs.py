"""Relational signals: trailing return windows per snapshot, networks on them, and daily panels of node statistics.

A snapshot is one group: names x window returns, bounded by the universe of one day. Snapshots run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import network as N
from gridloom.operators.factors import Factor, Registry
from gridloom.operators.panel import last_pos
from gridloom.operators.universe import restrict
from gridloom.sources.catalog import Catalog

#: Names and their window matrix (rows: calendar rows, columns: names) -> value per name; NaN or absent: none.
SnapshotFunction = Callable[[np.ndarray, list[str]], dict[str, float]]

PERIODS = {"W": "week", "M": "month", "Q": "quarter"}


def rebalance_days(days: DataFrame, freq: str | int = "M", start: int | None = None, end: int | None = None) -> DataFrame:
    """day, pos of the last calendar day of each period, or every ``freq`` calendar rows from the first; freq below 1 is an error."""
    rows = days
    if start is not None:
        rows = rows.where(F.col("day") >= start)
    if end is not None:
        rows = rows.where(F.col("day") <= end)
    if isinstance(freq, int) or str(freq).isdigit():
        if int(freq) < 1:
            raise ValueError("a schedule needs at least one day between dates")
        first = rows.agg(F.min("pos").alias("p")).first()["p"] or 0
        return rows.where((F.col("pos") - first) % int(freq) == 0).select("day", "pos")
    return rows.groupBy(
        F.date_trunc(PERIODS[freq], F.date_from_unix_date("day").cast("timestamp")).alias("_g")
    ).agg(F.max("day").alias("day"), F.max("pos").alias("pos")).select("day", "pos")


def window_rows(returns: DataFrame, snapshots: DataFrame, window: int = 120, least: int | None = None, spans: DataFrame | None = None) -> DataFrame:
    """snap, snap_day, ticker, back (0: the snapshot's own row), ret for names with at least ``least`` returns in the window (all of it by default); with spans only members on the snapshot's day.

    Each return row goes to the snapshots that see it: (window / days between snapshots) copies, by an equi-join on calendar position.
    """
    seen = snapshots.select(
        F.col("pos").alias("snap"), F.col("day").alias("snap_day"),
        F.explode(F.sequence(F.col("pos") - (window - 1), F.col("pos"))).alias("pos")
    )
    rows = returns.where("ret is not null").select("ticker", "pos", "ret").join(seen, "pos")
    rows = rows.select("snap", "snap_day", "ticker", (F.col("snap") - F.col("pos")).alias("back"), "ret")
    if spans is not None:
        rows = restrict(rows.withColumn("day", F.col("snap_day")), spans).drop("day")
    enough = F.count(F.lit(1)).over(Window.partitionBy("snap", "ticker")) >= (window if least is None else least)
    return rows.withColumn("_ok", enough).where("_ok").drop("_ok")


def matrix(pdf: pd.DataFrame, window: int) -> tuple[np.ndarray, list[str]]:
    names, code = np.unique(pdf["ticker"].to_numpy().astype(str), return_inverse=True)
    x = np.full((window, len(names)), np.nan)
    x[window - 1 - pdf["back"].to_numpy(), code] = pdf["ret"].to_numpy()
    return x, names.tolist()


def snapshot_values(rows: DataFrame, function: SnapshotFunction, window: int = 120) -> DataFrame:
    """snap, ticker, value of each snapshot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {k: v for k, v in function(*matrix(pdf, window)).items() if v is not None and np.isfinite(v)}
        return pd.DataFrame(
            {
                "snap": np.full(len(found), pdf["snap"].iloc[0], np.int32), "ticker": np.array(list(found), object),
                "value": np.array(list(found.values()), float)
            }
        )

    return rows.groupBy("snap").applyInPandas(run, "snap int, ticker string, value double")


def hold_until_next(values: DataFrame, days: DataFrame) -> DataFrame:
    """ticker, pos, day, value: each snapshot's value from its day until the ticker's next one, the last to the calendar's end. Intervals are unfolded, nothing is filled by window."""
    end = last_pos(days)
    following = F.lead("snap").over(Window.partitionBy("ticker").orderBy("snap"))
    spans = values.withColumn("_to", F.coalesce(following - 1, F.lit(end)))
    rows = spans.select("ticker", F.explode(F.sequence("snap", "_to")).alias("pos"), "value")
    return rows.join(F.broadcast(days), "pos").select("ticker", "pos", "day", "value")


class GraphFactor(Factor):
    """A node statistic computed at each snapshot over the universe of its day and held between them; in_universe=False takes every name."""

    def __init__(
        self, name: str, function: SnapshotFunction, window: int = 120, freq: str = "M", direction: int = 1, least: int | None = None,
        in_universe: bool = True
    ) -> None:
        super().__init__(name, direction)
        self.function, self.window, self.freq, self.least, self.in_universe = function, window, freq, least, in_universe

    def snapshots(self, catalog: Catalog) -> DataFrame:
        rows = window_rows(
            catalog.returns("log"), rebalance_days(catalog.days, self.freq), self.window, self.least,
            catalog.periods if self.in_universe else None
        )
        return snapshot_values(rows, self.function, self.window)

    def panel(self, catalog: Catalog) -> DataFrame:
        return hold_until_next(self.snapshots(catalog), catalog.days)


class ChangeFactor(GraphFactor):
    """Change of the held level from one rebalance day to the next."""

    def panel(self, catalog: Catalog) -> DataFrame:
        held = hold_until_next(self.snapshots(catalog), catalog.days)
        at = held.join(rebalance_days(catalog.days, self.freq).select("pos"), "pos", "left_semi")
        diff = at.select(
            "ticker", F.col("pos").alias("snap"),
            (F.col("value") - F.lag("value").over(Window.partitionBy("ticker").orderBy("pos"))).alias("value")
        )
        return hold_until_next(diff.where("value is not null"), catalog.days)


def _tree(x: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[str]]:
    ok = N.usable_columns(x)
    kept = [n for n, k in zip(names, ok, strict=True) if k]
    return (N.spanning_tree(N.shrunk_correlation(x[:, ok])) if len(kept) > 1 else np.zeros((len(kept), len(kept)))), kept


def tree_statistic(statistic: Callable[[np.ndarray], np.ndarray], least_names: int = 3) -> SnapshotFunction:
    """A centrality on the minimum spanning tree of shrunk correlations; nothing for fewer names."""

    def run(x: np.ndarray, names: list[str]) -> dict[str, float]:
        a, kept = _tree(x, names)
        return dict(zip(kept, statistic(a).tolist(), strict=True)) if len(kept) >= least_names else {}

    return run


def lead_lag_statistic(kind: str, lags: tuple[int, ...] = N.LAGS, alpha: float = 0.1, least_names: int = 10, lookback: int = 5) -> SnapshotFunction:
    """'out', 'in' or 'upstream' of the lead-lag network of market residuals."""
    if kind not in ("out", "in", "upstream"):
        raise ValueError(f"unknown statistic {kind!r}")

    def run(x: np.ndarray, names: list[str]) -> dict[str, float]:
        ok = N.usable_columns(x)
        kept = [n for n, k in zip(names, ok, strict=True) if k]
        if len(kept) < least_names:
            return {}
        e = N.residualised(x[:, ok])
        d = N.lead_lag(e, lags, alpha)
        v = {"out": lambda: N.out_degree(d), "in": lambda: N.in_degree(d), "upstream": lambda: N.upstream(d, e, lookback)}[kind]()
        return dict(zip(kept, v.tolist(), strict=True))

    return run


class VectorFactor(Factor):
    """Mean recent return of each name's nearest neighbours by the embedding of its latest filing, at each snapshot, held between them.

    store: ticker, filing_date, vec; the catalog's vectors by default. A filing holds from its date until the ticker's next one, so it is unfolded to the
    snapshots in between; a snapshot is one group, bounded by the universe.
    """

    def __init__(
        self, name: str, store: DataFrame | None = None, k: int = 20, freq: str = "M", lookback: int = 21, least_similarity: float = 0.0,
        least_names: int = 10, direction: int = 1, in_universe: bool = True
    ) -> None:
        super().__init__(name, direction)
        self.store, self.k, self.freq, self.lookback, self.least_similarity, self.least_names, self.in_universe = store, k, freq, lookback, least_similarity, least_names, in_universe

    def panel(self, catalog: Catalog) -> DataFrame:
        snaps = rebalance_days(catalog.days, self.freq)
        points = sorted((r["day"], r["pos"]) for r in snaps.collect())  # at most one a calendar day
        at = F.array(
            *(F.struct(F.lit(d).alias("day"), F.lit(p).alias("snap")) for d, p in points)
        ) if points else F.array().cast("array<struct<day:int,snap:int>>")
        store = catalog.vectors if self.store is None else self.store
        filed = store.groupBy("ticker", F.unix_date(F.to_date("filing_date")).alias("from")).agg(F.max("vec").alias("vec"))
        filed = filed.withColumn("to", F.lead("from").over(Window.partitionBy("ticker").orderBy("from")))
        seen = filed.withColumn("at", F.explode(F.filter(at, lambda x: (x["day"] >= F.col("from")) & (F.col("to").isNull() | (x["day"] < F.col("to"))))))
        known = seen.select("ticker", F.col("at.snap").alias("snap"), F.col("at.day").alias("day"), "vec")
        known = restrict(known, catalog.periods) if self.in_universe else known
        recent = window_rows(catalog.returns("log"), snaps, self.lookback, 1).groupBy("snap", "ticker").agg(F.avg("ret").alias("recent"))
        k, least_similarity, least_names = self.k, self.least_similarity, self.least_names

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ticker", ignore_index=True)
            n = len(pdf)
            if n < least_names:
                return pd.DataFrame({"snap": np.zeros(0, np.int32), "ticker": np.zeros(0, object), "value": np.zeros(0)})
            x = np.stack(pdf["vec"].to_numpy())
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1.0)
            sim = np.clip(x @ x.T, -1, 1)
            np.fill_diagonal(sim, -np.inf)
            near = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, n - 1)]
            w = np.take_along_axis(sim, near, axis=1)
            r = pdf["recent"].to_numpy(float)[near]
            w = np.where((w >= least_similarity) & ~np.isnan(r), w, 0.0)
            total = w.sum(axis=1)
            value = np.divide((w * np.nan_to_num(r)).sum(axis=1), total, out=np.full(n, np.nan), where=total > 0)
            ok = ~np.isnan(value)
            return pd.DataFrame({"snap": pdf["snap"].to_numpy(np.int32)[ok], "ticker": pdf["ticker"].to_numpy(object)[ok], "value": value[ok]})

        values = known.select("snap", "ticker", "vec").join(recent, ["snap", "ticker"], "left").groupBy("snap").applyInPandas(
            run, "snap int, ticker string, value double"
        )
        return hold_until_next(values, catalog.days)


GRAPH_FACTORS = Registry()
for _f in (
    GraphFactor("eigenvector_centrality_mst_120d", tree_statistic(N.eigenvector)),
    GraphFactor("degree_centrality_mst_120d", tree_statistic(N.degree)),
    ChangeFactor("delta_eigenvector_centrality_mst_120d", tree_statistic(N.eigenvector)),
    *(GraphFactor(f"leadlag_{k}_120d", lead_lag_statistic(k)) for k in ("out", "in", "upstream")),
    VectorFactor("text_neighbour_return_k20"),
):
    GRAPH_FACTORS.register(_f)


def clustering_table(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """snap, ticker, clustering, degree of every node (snap, ticker) from undirected edges (snap, src, dst, weight, each once).

    Stays in the engine and needs no matrix: every edge asks for the common neighbours of its ends, so a snapshot's cost is
    that of its edges and their triangles, not of its names squared. degree is the weight per possible neighbour.
    """
    both = edge_rows.select("snap", "src", "dst", "weight").union(edge_rows.select("snap", F.col("dst"), F.col("src"), "weight"))
    ends = both.groupBy("snap", F.col("src").alias("ticker")).agg(F.count(F.lit(1)).alias("_k"), F.sum("weight").alias("_w"))
    first = edge_rows.select("snap", F.col("src").alias("a"), F.col("dst").alias("b"))
    hop = both.select("snap", F.col("src").alias("a"), F.col("dst").alias("c"))
    back = both.select("snap", F.col("src").alias("b"), F.col("dst").alias("c"))
    triangles = first.join(hop, ["snap", "a"]).join(back, ["snap", "b", "c"])  # each triangle once per edge, seen from its third node
    closed = triangles.groupBy("snap", F.col("c").alias("ticker")).agg(F.count(F.lit(1)).alias("_t"))
    n = nodes.groupBy("snap").agg(F.countDistinct("ticker").alias("_n"))
    out = nodes.select("snap", "ticker").distinct().join(n, "snap").join(ends, ["snap", "ticker"], "left").join(closed, ["snap", "ticker"], "left")
    pairs = F.col("_k") * (F.col("_k") - 1) / 2
    return out.select(
        "snap", "ticker", F.coalesce(F.try_divide(F.col("_t"), pairs), F.lit(0.0)).alias("clustering"),
        (F.coalesce("_w", F.lit(0.0)) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("degree")
    )


def edges(rows: DataFrame, graph: str = "mst", least: float = 0.3, window: int = 120) -> DataFrame:
    """snap, src, dst, weight of each snapshot's network: 'mst', 'threshold' (src < dst) or 'leadlag' (directed)."""
    if graph not in ("mst", "threshold", "leadlag"):
        raise ValueError(f"unknown graph {graph!r}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, names = matrix(pdf, window)
        ok = N.usable_columns(x)
        kept = np.array(names, object)[ok]
        if len(kept) < 2:
            a = np.zeros((0, 0))
        elif graph == "leadlag":
            a = N.lead_lag(N.residualised(x[:, ok]))
        else:
            c = N.shrunk_correlation(x[:, ok])
            a = np.triu(N.spanning_tree(c) if graph == "mst" else N.threshold_graph(c, least))
        i, j = np.nonzero(a)
        return pd.DataFrame({"snap": np.full(len(i), pdf["snap"].iloc[0], np.int32), "src": kept[i], "dst": kept[j], "weight": a[i, j]})

    return rows.groupBy("snap").applyInPandas(run, "snap int, src string, dst string, weight double")


def node_table(rows: DataFrame, window: int = 120, least: float = 0.3, seed: int = 0) -> DataFrame:
    """snap, ticker, degree, eigenvector, clustering, betweenness, community, cohesion: the tree's statistics, clustering on the threshold graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, names = matrix(pdf, window)
        ok = N.usable_columns(x)
        kept = np.array(names, object)[ok]
        n = len(kept)
        c = N.shrunk_correlation(x[:, ok]) if n > 1 else np.ones((n, n))
        a = N.spanning_tree(c)
        label = N.communities(a, seed) if n else np.zeros(0, int)
        empty = np.zeros(n)
        return pd.DataFrame({
            "snap": np.full(n, pdf["snap"].iloc[0], np.int32), "ticker": kept, "degree": N.degree(a) if n else empty, "eigenvector": N.eigenvector(a) if n else empty,
            "clustering": N.clustering(N.threshold_graph(c, least)) if n else empty, "betweenness": N.betweenness(a) if n else empty, "community": label.astype(np.int64), "cohesion": N.cohesion(a, label) if n else empty,
        })

    return rows.groupBy("snap").applyInPandas(
        run,
        "snap int, ticker string, degree double, eigenvector double, clustering double, betweenness double, community long, cohesion double"
    )


def density_report(rows: DataFrame, window: int = 120, shuffles: int = 200, seed: int = 0, alpha: float = 0.1, null: bool = True) -> DataFrame:
    """snap, n_names, n_edges, density, null_mean, null_q95, p_value, autocorrelation: lead-lag density against a null of shifted series.

    The replicates of a snapshot are spread over tasks: every (snapshot, block of replicates) is a group with its own copy
    of the window. null=False leaves out the null and its three columns.
    """
    blocks = 8 if null else 1
    copies = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        snap, block = key
        x, _ = matrix(pdf, window)
        e = N.residualised(x[:, N.usable_columns(x)])
        if e.shape[1] < 2:
            return pd.DataFrame({"snap": pd.Series([], dtype=np.int32), "rep": [], "n_names": [], "n_edges": [], "density": [], "autocorrelation": []})
        reps = list(range(block, shuffles, blocks)) if null else []
        out = [(r, e.shape[1], 0, N.shuffled_density(e, seed * 1_000_003 + r, alpha=alpha), 0.0) for r in reps]
        if block == 0:
            d = N.lead_lag(e, alpha=alpha)
            out.append((-1, e.shape[1], int((d != 0).sum()), N.density(d), N.mean_abs_autocorrelation(e)))
        return pd.DataFrame([(snap, *r) for r in out], columns=["snap", "rep", "n_names", "n_edges", "density", "autocorrelation"])

    each = copies.groupBy("snap", "block").applyInPandas(run, "snap int, rep int, n_names int, n_edges int, density double, autocorrelation double")
    actual = each.where("rep < 0").select("snap", "n_names", "n_edges", "density", "autocorrelation")
    if not null:
        return actual
    null_rows = each.where("rep >= 0").select("snap", F.col("density").alias("_d")).join(actual.select("snap", "density"), "snap")
    stats = null_rows.groupBy("snap").agg(
        F.avg("_d").alias("null_mean"), F.percentile("_d", F.lit(0.95)).alias("null_q95"),
        F.avg((F.col("_d") >= F.col("density")).cast("double")).alias("p_value")
    )
    return actual.join(stats, "snap")


def neutralised(
    values: DataFrame, controls: dict[str, DataFrame] | None = None, sectors: DataFrame | None = None, rank: bool = True, least: int = 10
) -> DataFrame:
    """day, ticker, value: per day the residual of (ranked) values on (ranked) controls and sector dummies.

    Names without a control or sector are left out; days with fewer than ``least`` names give nothing. With sectors only,
    this is the value less its sector mean and stays inside the engine. controls: name -> (day, ticker, value).
    """
    rows = values.where("value is not null").select("day", "ticker", "value")
    names = sorted(controls or {})
    for c in names:
        rows = rows.join(controls[c].where("value is not null").select("day", "ticker", F.col("value").alias(f"_c_{c}")), ["day", "ticker"])
    if sectors is not None:
        rows = rows.join(sectors.select("ticker", "sector"), "ticker")
    on_day = Window.partitionBy("day")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(on_day)).where(F.col("_n") >= least).drop("_n")
    if rank:
        for c in ["value", *(f"_c_{x}" for x in names)]:
            rows = rows.withColumn(c, F.rank().over(on_day.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("day", c)) - 1) / 2.0)
    if not names:
        by = ["day", "sector"] if sectors is not None else ["day"]
        return rows.select("day", "ticker", (F.col("value") - F.avg("value").over(Window.partitionBy(*by))).alias("value"))

    with_sectors = sectors is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        design = [np.ones(len(pdf)), *(pdf[f"_c_{c}"].to_numpy(float) for c in names)]
        if with_sectors:
            labels = np.unique(pdf["sector"].astype(str))
            design += [(pdf["sector"].astype(str) == s).to_numpy(float) for s in labels[1:]]
        return pd.DataFrame({"day": pdf["day"], "ticker": pdf["ticker"], "value": N.residual_of(pdf["value"].to_numpy(float), np.column_stack(design))})

    return rows.groupBy("day").applyInPandas(run, "day int, ticker string, value double")


def cluster_sector_table(nodes: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snap, community, sector, n), (snap, n, adjusted_rand): communities against sectors, from contingency counts."""
    cells = nodes.join(sectors, "ticker").groupBy("snap", "community", "sector").agg(F.count(F.lit(1)).alias("n"))

    def pairs(c: str) -> F.Column:
        return F.sum(F.col(c) * (F.col(c) - 1) / 2)

    a = cells.groupBy("snap").agg(pairs("n").alias("_p"), F.sum("n").alias("n"))
    b = cells.groupBy("snap", "community").agg(F.sum("n").alias("_r")).groupBy("snap").agg(pairs("_r").alias("_rows"))
    c = cells.groupBy("snap", "sector").agg(F.sum("n").alias("_s")).groupBy("snap").agg(pairs("_s").alias("_cols"))
    j = a.join(b, "snap").join(c, "snap")
    expected = F.try_divide(F.col("_rows") * F.col("_cols"), F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("_rows") + F.col("_cols")) / 2
    return cells, j.select(
        "snap", "n",
        F.when(most == F.coalesce(expected, F.lit(0.0)), 1.0).otherwise(
            (F.col("_p") - F.coalesce(expected, F.lit(0.0))) / (most - F.coalesce(expected, F.lit(0.0)))
        ).alias("adjusted_rand")
    )


def iterate_labels(tables: Iterator[dict[str, int]]) -> Iterator[dict[str, int]]:
    """Communities of successive snapshots with stable numbers."""
    before: dict[str, int] = {}
    for now in tables:
        before = N.align_labels(before, now)
        yield before
