"""The general data problems against brute force, with dirty rows, hot keys, empty tables and clashing columns."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import asof, grid, intervals, rolling, spikes, widen

FACTS = "fact_id long, ticker string, available_date timestamp_ntz, field string, value double, period_end timestamp_ntz, loaded_at timestamp_ntz"
PRICES = "date timestamp_ntz, ticker string, close double, `adj close` double, volume double, loaded_at timestamp_ntz"
NAN = float("nan")
T0 = dt.datetime(2020, 1, 1)


def sym(x):
    return x.strip().upper().replace(".", "-") if x and x.strip() else None


def fld(x):
    return x.strip().lower().replace(" ", "_").replace("-", "_") if x and x.strip() else None


def random_facts(n, seed, tickers=("AA", " aa", "b.c", "B-C", None), span=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(days=rng.randrange(span), hours=rng.choice([0, 0, 9, 15])) if rng.random() > 0.05 else None
        value = rng.choice([1.0, 2.5, NAN, None, 7.0, -3.0, 20200230.0, 20200229.0, 0.0])
        end = T0 + dt.timedelta(days=rng.randrange(3)) if rng.random() > 0.2 else None
        out.append((i, rng.choice(tickers), at, rng.choice(["Book Equity", "book-equity", "total_assets ", None]), value, end, T0))
    return out + out[: n // 4]


def usable(facts):
    return [(sym(t), fld(f), at, end or dt.datetime.min, i, v) for i, t, at, f, v, end, _ in facts if sym(t) and fld(f) and at and v is not None and not math.isnan(v)]


def test_quarters_against_brute_force(rows):
    facts = random_facts(160, 1)
    got = {(r["ticker"], r["field"], r["cal_quarter"]): r for r in grid.to_quarters(rows(FACTS, facts)).collect()}
    by = {}
    for t, f, at, end, i, v in set(usable(facts)):
        by.setdefault((t, f), {}).setdefault(at, []).append((end, i, v))
    want = 0
    for (t, f), instants in by.items():
        steps = sorted((at, max(r)[2]) for at, r in instants.items())
        q = lambda x: x.year * 4 + (x.month - 1) // 3
        start = lambda k: dt.datetime(k // 4, k % 4 * 3 + 1, 1)
        for k in range(q(steps[0][0]), q(steps[-1][0]) + 1):
            want += 1
            r = got[t, f, f"{k // 4:04d}Q{k % 4 + 1}"]
            own = [v for at, v in steps if q(at) == k]
            assert r["n_readings"] == len(own) and r["is_missing"] == (not own) and r["value"] == (own[-1] if own else None)
            assert r["filled_value"] == [v for at, v in steps if q(at) <= k][-1]
            area = covered = 0.0
            for (at, v), nxt in zip(steps, [s[0] for s in steps[1:]] + [dt.datetime.max], strict=True):
                a, b = max(at, start(k)), min(nxt, start(k + 1))
                if b > a:
                    area, covered = area + v * (b - a).total_seconds(), covered + (b - a).total_seconds()
            assert r["time_weighted"] == pytest.approx(area / covered)
            assert r["coverage"] == pytest.approx(covered / (start(k + 1) - start(k)).total_seconds())
    assert want == len(got)


def test_quarters_do_not_depend_on_shards(rows):
    facts = rows(FACTS, random_facts(400, 2))
    whole = sorted(map(str, grid.to_quarters(facts).collect()))
    cut = sorted(map(str, grid.to_quarters(facts, most=5).collect()))
    assert whole == cut and whole


def test_quarters_of_nothing(rows):
    assert grid.to_quarters(rows(FACTS)).count() == 0
    assert grid.to_quarters(rows(FACTS, [(1, None, T0, "x", 1.0, None, None), (2, "A", None, "x", 1.0, None, None)])).count() == 0


def decisions(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(days=rng.randrange(-30, 950), hours=rng.choice([0, 9, 12])) if rng.random() > 0.05 else None
        out.append((i, rng.choice(["AA", "b.c ", None, "zz"]), at, rng.choice(["Book-Equity", "total assets", None]), rng.choice([1.0, 2.5, NAN, None, 2.504, 2.506])))
    return out + out[:20]


EVENTS = "event_id long, ticker string, decided_at timestamp_ntz, field string, used_value double"


@pytest.mark.parametrize("limits", [{}, {"most": 3}, {"most": 40}])
def test_known_at_decision_against_brute_force(rows, limits):
    facts, events = random_facts(300, 3), decisions(200, 4)
    got = {r["event_id"]: r for r in asof.known_at_decision(rows(EVENTS, events), rows(FACTS, facts), **limits).collect()}
    assert len(got) == 200
    use = usable(facts)
    found = set()
    for i, t, at, f, u in events:
        known = max(((a, e, k, v) for tt, ff, a, e, k, v in use if at and tt == sym(t) and ff == fld(f) and a <= at), default=None)
        assert got[i]["known_value"] == (known[3] if known else None)
        assert got[i]["known_fact_id"] == (known[2] if known else None)
        u = None if u is None or math.isnan(u) else u
        k = known[3] if known else None
        if (u is None) != (k is None) or (u is not None and abs(u - k) > 0.005):
            found.add(i)
    assert {r["event_id"] for r in asof.disagreements(asof.known_at_decision(rows(EVENTS, events), rows(FACTS, facts), **limits)).collect()} == found


def test_known_with_an_empty_side(rows):
    assert asof.known_at_decision(rows(EVENTS), rows(FACTS, random_facts(9, 1))).count() == 0
    r = asof.known_at_decision(rows(EVENTS, decisions(5, 1)), rows(FACTS)).collect()
    assert r and all(x["known_value"] is None for x in r)


def random_prices(seed, tickers=("AA", "b.b"), days=420):
    rng = random.Random(seed)
    out = []
    for t in tickers:
        p, v = 50.0, 1000.0
        for k in range(days):
            if rng.random() < 0.3 or 100 < k < 170:
                continue
            p, v = round(p * math.exp(rng.gauss(0, 0.01)), 2), float(int(v * math.exp(rng.gauss(0, 0.6)))) + 1
            v = min(max(v, 2), 1e6)
            at = T0 + dt.timedelta(days=k)
            c = rng.choice([p, p, p, p, p * 3, None, NAN, -1.0, 0.0]) if rng.random() < 0.2 else p
            vol = rng.choice([v, None, NAN, -5.0, 0.0]) if rng.random() < 0.1 else v
            row = (at, rng.choice([t, f" {t.lower()}"]), c, None if rng.random() < 0.03 else p, vol, at)
            out += [row, row] if rng.random() < 0.1 else [row]
            if rng.random() < 0.1:  # superseded
                out.append((at, t, 1.0, 1.0, 1.0, at - dt.timedelta(days=1)))
    rng.shuffle(out)
    return out


def bars(prices):
    best = {}
    clean = lambda x: None if x is None or math.isnan(x) else x
    for at, t, c, a, v, loaded in prices:
        key = (sym(t), at.date())
        if key not in best or loaded > best[key][0]:
            best[key] = (loaded, clean(c), clean(a), clean(v))
    return {k: v[1:] for k, v in best.items()}


@pytest.mark.parametrize("tile", [30, 64, 256])
def test_trailing_totals_against_brute_force(rows, tile):
    prices = random_prices(5)
    b = bars(prices)
    got = {(r["ticker"], r["day"]): r for r in rolling.trailing_totals(rows(PRICES, prices), tile=tile).collect()}
    cases = {(r["ticker"], r["obs_day"], r["kind"]) for r in rolling.turnover_shifts(rows(PRICES, prices), tile=tile).collect()}
    want_cases, n = set(), 0
    for t in {k[0] for k in b}:
        days = [k[1] for k in b if k[0] == t]
        d = min(days)
        while d <= max(days):
            n += 1
            r = got[t, (d - dt.date(1970, 1, 1)).days]
            mean = {}
            for w in (7, 30):
                back = [b.get((t, d - dt.timedelta(days=j))) for j in range(w)]
                flow = sum(x[0] * x[2] for x in back if x and x[0] and x[0] > 0 and x[2] and x[2] > 0)
                adj = [x[1] for x in back if x and x[1] is not None]
                mean[w] = flow / w
                assert r[f"flow_sum_{w}"] == pytest.approx(flow) and r[f"price_n_{w}"] == len(adj)
                assert r[f"price_avg_{w}"] == (pytest.approx(sum(adj) / len(adj)) if adj else None)
            if (d - min(days)).days >= 29:
                if mean[7] > 2.5 * mean[30]:
                    want_cases.add((t, str(d), "surge"))
                if mean[7] < 0.2 * mean[30]:
                    want_cases.add((t, str(d), "dry"))
            d += dt.timedelta(days=1)
    assert n == len(got) and cases == want_cases and cases


def test_trailing_totals_edges(rows):
    assert rolling.trailing_totals(rows(PRICES)).count() == 0
    one = rolling.trailing_totals(rows(PRICES, [(T0, "A", 2.0, None, 3.0, None), (None, "A", 1.0, 1.0, 1.0, None), (T0, None, 1.0, 1.0, 1.0, None)])).collect()
    assert len(one) == 1 and one[0]["flow_sum_30"] == 6.0 and one[0]["price_avg_7"] is None
    big = rolling.trailing_totals(rows(PRICES, [(T0 + dt.timedelta(days=k), "A", math.inf if k == 3 else 1.0, 1.0, 1.0, T0) for k in range(20)])).collect()
    assert [math.isinf(r["flow_sum_7"]) for r in sorted(big, key=lambda r: r["day"])] == [3 <= k < 10 for k in range(20)]
    with pytest.raises(ValueError):
        rolling.trailing_totals(rows(PRICES), windows=(7, 400))


def spike_oracle(b):
    out = {}
    for t in {k[0] for k in b}:
        days = sorted(k[1] for k in b if k[0] == t)
        for m, name in enumerate(("close", "adj close", "volume")):
            seq = [(d, b[t, d][m]) for d in days if b[t, d][m] is not None]
            for d, x in seq:
                if x < 0 or (x == 0 and name != "volume"):
                    out[t, str(d), name] = 1
            pos = [(d, x) for d, x in seq if x > 0]
            log = [math.log(x) for _, x in pos]
            change = [abs(q - p) for p, q in zip(log, log[1:], strict=False) if p != q]
            same = sum(p[1] == q[1] for p, q in zip(pos, pos[1:], strict=False))
            hit = {}
            if change:
                s = 10 * statistics.median(change)
                for length in (1, 2, 3):
                    for i in range(1, len(pos) - length):
                        for sign in (1, -1):
                            if all(sign * (log[k] - log[i - 1]) > s and sign * (log[k] - log[i + length]) > s for k in range(i, i + length)):
                                for k in range(i, i + length):
                                    hit[k] = hit.get(k, 0) | 2
            if not 2 * same >= len(pos):
                i = 0
                while i < len(pos):
                    j = i
                    while j + 1 < len(pos) and pos[j + 1][1] == pos[i][1]:
                        j += 1
                    if j - i + 1 >= 6:
                        for k in range(i + 1, j + 1):
                            hit[k] = hit.get(k, 0) | 4
                    i = j + 1
            for k, bit in hit.items():
                out[t, str(pos[k][0]), name] = out.get((t, str(pos[k][0]), name), 0) | bit
    return out


def test_spikes_against_brute_force(rows):
    prices = random_prices(6, ("AA", "bb", "C.C"))
    rng = random.Random(7)
    for t, level in (("QQ", 9.0), ("RR", 5.0)):  # frozen stretches, hardly ever a new price
        p = level
        for k in range(120):
            if t == "QQ" and not 40 <= k < 50 or rng.random() < 0.1:
                p = round(p * math.exp(rng.gauss(0, 0.02)), 2)
            for x in [p * 4 if t == "QQ" and k in (70, 71, 72, 90) else p]:
                prices.append((T0 + dt.timedelta(days=k), t, x, x, 5.0, T0))
    want = spike_oracle(bars(prices))
    got = {(r["ticker"], r["obs_day"], r["measure"]): r["reasons"] for r in spikes.implausible(rows(PRICES, prices)).collect()}
    assert got == want and {1, 2, 4} <= set(want.values())


def test_spikes_edges(rows):
    assert spikes.implausible(rows(PRICES)).count() == 0
    flat = [(T0 + dt.timedelta(days=k), "A", 1.0, 1.0, 0.0, T0) for k in range(30)]
    assert spikes.implausible(rows(PRICES, flat)).count() == 0
    r = spikes.implausible(rows(PRICES, [(T0, "A", 0.0, math.inf, -1.0, None)])).collect()
    assert sorted((x["measure"], x["reasons"]) for x in r) == [("adj close", 1), ("close", 1), ("volume", 1)]


TYPES = "field string, sql_type string"


def test_widen_against_brute_force(rows):
    facts = random_facts(200, 8, tickers=("AA", "bb", "c.c", None, "dd"), span=40) + [(999, "only", T0, "other", 1.0, None, T0)]
    types = [("book_equity", "date"), ("Total Assets", "bigint"), ("is_x", "boolean"), (None, "double")]
    wide = {r["ticker"]: r.asDict() for r in widen.widen(rows(FACTS, facts), rows(TYPES, types)).collect()}
    cells = {(r["ticker"], r["field"], r["fact_id"]) for r in widen.filled_cells(rows(FACTS, facts), rows(TYPES, types)).collect()}
    assert set(wide) == {sym(f[1]) for f in facts if sym(f[1])}
    want = set()
    for t in wide:
        for f, kind in (("book_equity", "date"), ("total_assets", "bigint"), ("is_x", "boolean")):
            last = max(((a, e, i, v) for tt, ff, a, e, i, v in usable(facts) if tt == t and ff == f), default=None)
            cell = None
            if last and kind == "date" and last[3] == 20200229.0:
                cell = dt.date(2020, 2, 29)
            if last and kind == "bigint" and last[3] == int(last[3]):
                cell = int(last[3])
            assert wide[t][f] == cell
            if cell is not None:
                want.add((t, f, last[2]))
    assert cells == want and cells


def test_widen_types(rows):
    at = [(i, "A", T0, "x", v, None, T0) for i, v in enumerate([1.0])]
    for kind, value, out in [("boolean", 1.0, True), ("boolean", 0.0, False), ("boolean", 2.0, None), ("bigint", 1.5, None), ("bigint", math.inf, None), ("bigint", 1e300, None), ("double", math.inf, math.inf), ("date", 20230229.0, None), ("date", 1011.0, None), ("date", -20200101.0, None), ("date", 20201231.0, dt.date(2020, 12, 31)), ("date", 10530.0, dt.date(1, 5, 30)), ("date", 10101.0, dt.date(1, 1, 1)), ("date", 530.0, None), ("date", 9991231.0, dt.date(999, 12, 31)), ("date", 11332.0, None), ("bigint", 9.21e18, 9210000000000000000), ("bigint", -(2.0**63), -(2**63)), ("bigint", 2.0**63, None), ("bigint", -0.0, 0)]:
        facts = [(*at[0][:4], value, None, T0)]
        assert widen.widen(rows(FACTS, facts), rows(TYPES, [("x", kind)])).first()["x"] == out, (kind, value)
    assert widen.widen(rows(FACTS, at), rows(TYPES)).columns == ["ticker"]
    assert widen.filled_cells(rows(FACTS), rows(TYPES, [("x", "double")])).count() == 0
    with pytest.raises(ValueError):
        widen.widen(rows(FACTS, at), rows(TYPES, [("x", "money")]))
    many = rows(TYPES, [(f"f{i}", "double") for i in range(2_100)] + [("x", "double")])
    assert widen.filled_cells(rows(FACTS, at), many).collect() == [("A", "x", 0)]


def test_haar_details_rebuild_the_readings():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 4, 50]
    x, source = rng.normal(size=sum(sizes)), np.repeat(np.arange(len(sizes)), sizes)
    d = spikes.Details(x, source)
    at = 0
    for n in sizes:
        own = x[at : at + n]
        padded = np.concatenate((np.full(4, own[0]), own, np.full(4, own[-1])))
        s1 = (padded[1:] + padded[:-1]) / 2
        s2 = (s1[2:] + s1[:-2]) / 2  # s2[i] belongs to padded[i + 3]
        p = d.place[at : at + n]
        assert np.allclose(s2[1 : n + 1] + d.fine[p] + d.coarse[p], own)
        at += n
    for i in range(len(x)):
        n = int((source == source[i]).sum())
        k = i - int(np.flatnonzero(source == source[i])[0])
        if 1 <= k < n - 1:
            assert np.isclose(d.rise(np.array([i]), 1)[0], x[i] - x[i - 1]) and np.isclose(d.rise(np.array([i]), 2)[0], (x[i] + x[i + 1]) / 2 - x[i - 1])
            assert np.isclose(d.fall(np.array([i]), 1)[0], x[i] - x[i + 1]) and np.isclose(d.fall(np.array([i]), 2)[0], (x[i] + x[i - 1]) / 2 - x[i + 1])


SPANS = "ticker string, start_date timestamp_ntz, end_date timestamp_ntz"


def test_periods_against_brute_force(rows):
    rng = random.Random(9)
    data = []
    for _ in range(300):
        a = T0 + dt.timedelta(days=rng.randrange(3000))
        data.append((rng.choice(["A", " a ", "b.b", None]), None if rng.random() < 0.01 else a, None if rng.random() < 0.01 else a + dt.timedelta(days=rng.randrange(-3, 25))))
    data += data[:50]
    got = {tuple(r) for r in intervals.continuous_periods(rows(SPANS, data), block_days=100).collect()}
    want = set()
    for t in ("A", "B-B"):
        pieces = sorted(((s or dt.datetime(1, 1, 1)).date(), (e or dt.datetime(2099, 12, 31)).date()) for x, s, e in data if sym(x) == t)
        merged = []
        for s, e in pieces:
            if e <= s:
                continue
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want |= {(t, "period", str(s), str(e)) for s, e in merged} | {(t, "gap", str(p[1]), str(q[0])) for p, q in zip(merged, merged[1:], strict=False)}
    assert got == want and got


def test_interval_map_is_order_free():
    rng = random.Random(10)
    for _ in range(200):
        data = [(a, a + rng.randrange(0, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(12)))]
        maps = []
        for _ in range(2):
            rng.shuffle(data)
            m = intervals.IntervalMap()
            for a, b in data:
                m.insert(a, b)
            maps.append(m.periods())
        covered = {x for a, b in data for x in range(a, b)}
        assert maps[0] == maps[1] and {x for a, b in maps[0] for x in range(a, b)} == covered
        assert all(p[1] < q[0] for p, q in zip(maps[0], maps[0][1:], strict=False))


def test_periods_of_nothing(rows):
    assert intervals.continuous_periods(rows(SPANS)).count() == 0
    assert intervals.continuous_periods(rows(SPANS, [("A", T0, T0), (None, T0, None)])).count() == 0


def clashing(df):
    """Extra columns whose names clash with the table's own and with the operators'."""
    extra = ["Ticker", "TICKER", "value", "shard", "t", "day", "tile", "_r", "start", "pos"]
    return df.select("*", *(F.lit("junk").alias(c) for c in extra if c not in df.columns))


def test_clashing_columns_change_nothing(rows):
    facts, prices = rows(FACTS, random_facts(60, 11)), rows(PRICES, random_prices(12, days=60))
    events, spans, types = rows(EVENTS, decisions(30, 13)), rows(SPANS, [("A", T0, None), ("a", None, T0)]), rows(TYPES, [("book_equity", "double")])
    for f, tables in (
        (grid.to_quarters, [facts]), (asof.known_at_decision, [events, facts]), (rolling.turnover_shifts, [prices]), (rolling.trailing_totals, [prices]),
        (spikes.implausible, [prices]), (widen.widen, [facts, types]), (widen.filled_cells, [facts, types]), (intervals.continuous_periods, [spans]),
    ):
        assert sorted(map(str, f(*tables).collect())) == sorted(map(str, f(*map(clashing, tables)).collect())), f.__name__


def test_a_hot_key_is_cut_into_shards(rows):
    from gridloom.operators.sharding import plan_shards

    day = 86_400_000_000
    data = [("hot", k * day // 3) for k in range(3000)]  # a thousand days
    data += [("hot", 500 * day + k) for k in range(400)]  # cells of 25 days and of minutes that are too full
    data += [("hot", 700 * day)] * 95 + [(f"k{k}", k) for k in range(500)] + [("hot", None)]
    df = rows("key string, t long", data)
    plan = plan_shards(df, ["key"], "t", most=30)
    assert plan.n_hot == 1 and [r["key"] for r in plan.hot.collect()] == ["hot"]
    got = sorted((r["key"], r["t"] or 0, r["shard"], r["salts"]) for r in plan.assign(df, "t").collect())
    assert len(got) == len(data)
    size, before = {}, -1
    for key, t, shard, salts in got:
        if key != "hot":
            assert (shard, salts) == (0, 1)
            continue
        assert before <= shard <= t  # in order of time
        before = shard
        size[shard] = size.get(shard, 0) + 1
        assert salts == (4 if t == 700 * day else 1)
    assert max(n for s, n in size.items() if s != 700 * day) <= 30 and size[700 * day] in (95, 96)
    assert plan_shards(df, ["key"], "t").hot is None


@pytest.mark.parametrize("most", [7, 1000])
def test_many_events_of_one_microsecond(rows, most):
    facts = [(i, "A", T0 + dt.timedelta(microseconds=i), "x", float(i), None, T0) for i in range(40)]
    events = [(i, "A", T0 + dt.timedelta(microseconds=20 if i < 60 else i), "x", float(i)) for i in range(90)] + [(90, "A", T0 - dt.timedelta(days=99), "x", 1.0)]
    got = {r["event_id"]: r["known_value"] for r in asof.known_at_decision(rows(EVENTS, events), rows(FACTS, facts), most).collect()}
    assert got == {i: 20.0 if i < 60 else min(i, 39.0) for i in range(90)} | {90: None}
