"""Queries of the general data problems (p1 to p6), each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.asof import disagreements, known_at_decision
from gridloom.operators.columns import day_label
from gridloom.operators.grid import to_quarters
from gridloom.operators.intervals import continuous_periods
from gridloom.operators.rolling import trailing_totals, turnover_shifts
from gridloom.operators.spikes import implausible
from gridloom.operators.widen import filled_cells, widen
from gridloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cells = to_quarters(table(spark, d, "fundamentals"), ["book_equity", "total_assets"])
    return cells.where("is_missing").select("ticker", "field", "cal_quarter")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(to_quarters(table(spark, d, "fundamentals")))


def _grid(cells: DataFrame) -> DataFrame:
    ratio = F.round(F.try_divide(F.col("time_weighted"), F.col("filled_value")), 6) + 0.0
    mean = F.col("time_weighted")
    mean = F.when(F.abs(mean) >= 1e8, F.round(mean, -3)).when(F.abs(mean) >= 1e4, F.round(mean, 0)).otherwise(F.round(mean, 6)) + 0.0
    return cells.select(
        "ticker", "field", "cal_quarter", "value", "is_missing", "filled_value", "n_readings", mean.alias("time_weighted"),
        ratio.alias("mean_to_close"), F.round("coverage", 6).alias("coverage")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return disagreements(known_at_decision(table(spark, d, "rebalances"), table(spark, d, "fundamentals"))).select("event_id")


def p2_known(spark: SparkSession, d: str) -> DataFrame:
    return _known(known_at_decision(table(spark, d, "rebalances"), table(spark, d, "fundamentals")))


def _known(known: DataFrame) -> DataFrame:
    return known.select("event_id", "ticker", "field", "used_value", "known_value", "known_fact_id")


#: Rows a key may have before it is cut in the _sharded queries: so few that nearly every key goes through shards and carry-in.
FEW_ROWS = 12


def p1_grid_sharded(spark: SparkSession, d: str) -> DataFrame:
    """p1_grid with its keys cut into time shards as hot keys are."""
    return _grid(to_quarters(table(spark, d, "fundamentals"), most=FEW_ROWS))


def p2_known_sharded(spark: SparkSession, d: str) -> DataFrame:
    """p2_known with its keys cut into time shards as hot keys are."""
    return _known(known_at_decision(table(spark, d, "rebalances"), table(spark, d, "fundamentals"), most=FEW_ROWS))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return turnover_shifts(table(spark, d, "prices"))


def p3_trailing(spark: SparkSession, d: str) -> DataFrame:
    t = trailing_totals(table(spark, d, "prices"))
    sums = {w: F.round(f"flow_sum_{w}", 2) for w in (7, 30)}
    prices = {w: F.round(f"price_sum_{w}", 4) for w in (7, 30)}
    out = ["ticker", day_label(F.col("day")).alias("obs_day")]
    for w in (7, 30):
        out += [
            sums[w].alias(f"flow_sum_{w}"), F.round(sums[w] / w, 4).alias(f"flow_avg_{w}"), F.col(f"price_n_{w}"),
            F.round(F.try_divide(prices[w], F.col(f"price_n_{w}")), 6).alias(f"price_avg_{w}")
        ]
    return t.select(*out)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cells(table(spark, d, "fundamentals"), table(spark, d, "field_types"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return widen(table(spark, d, "fundamentals"), table(spark, d, "field_types"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "prices")).select("ticker", "obs_day", "measure")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "prices"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return continuous_periods(table(spark, d, "membership"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_grid, p1_grid_sharded, p2_found, p2_known, p2_known_sharded, p3_found, p3_trailing, p4_found, p4_wide, p5_found, p5_reasons, p6_found)
}

_TICKER = "nullif(replace(upper(trim({0}ticker, E' \\t\\n\\r\\x0b\\x0c')), '.', '-'), '')"
_FIELD = "nullif(translate(lower(trim({0}field, E' \\t\\n\\r\\x0b\\x0c')), ' -', '__'), '')"
_USABLE = f"""usable as (
  select distinct {_TICKER.format('')} as ticker, {_FIELD.format('')} as field, available_date as t, value, period_end, fact_id
  from fundamentals where available_date is not null and value is not null and not isnan(value)),
good as (select * from usable where ticker is not null and field is not null),
inst as (select * from (select *, row_number() over (partition by ticker, field, t order by period_end desc nulls last, fact_id desc nulls last, value desc) as rn from good) where rn = 1)"""

_BARS = f"""bars as (
  select ticker, day, close, adj, volume from (
    select *, row_number() over (partition by ticker, day order by loaded_at desc nulls last, close desc nulls last, adj desc nulls last, volume desc nulls last) as rn from (
      select {_TICKER.format('')} as ticker, cast(date as date) as day, case when not isnan(close) then close end as close,
        case when not isnan("adj close") then "adj close" end as adj, case when not isnan(volume) then volume end as volume, loaded_at from prices)
    where ticker is not null and day is not null) where rn = 1)"""

_CELLS = f"""with {_USABLE},
q as (select *, year(t) * 4 + quarter(t) - 1 as q from inst),
span as (select ticker, field, min(q) as a, max(q) as b from q group by 1, 2),
cells as (select ticker, field, unnest(range(a, b + 1)) as q from span)"""

_TRAILING = f"""with {_BARS},
span as (select ticker, min(day) as a, max(day) as b from bars group by 1),
days as (select ticker, a, unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day))::date as day from span),
dense as (select d.ticker, d.a, d.day, coalesce(case when close > 0 and volume > 0 then close * volume end, 0) as flow, adj from days d left join bars b on d.ticker = b.ticker and d.day = b.day),
roll as (select ticker, a, day,
  sum(flow) over w7 as f7, sum(flow) over w30 as f30, sum(adj) over w7 as s7, sum(adj) over w30 as s30, count(adj) over w7 as n7, count(adj) over w30 as n30
  from dense window w7 as (partition by ticker order by day rows between 6 preceding and current row), w30 as (partition by ticker order by day rows between 29 preceding and current row))"""

_TYPED = """case f.sql_type when 'double' then true
  when 'bigint' then l.value = floor(l.value) and l.value >= -9223372036854775808::double and l.value < 9223372036854775808::double
  when 'boolean' then l.value in (0, 1)
  when 'date' then l.value = floor(l.value) and l.value between 10101 and 99991231 and try_strptime(lpad(cast(try_cast(l.value as bigint) as varchar), 8, '0'), '%Y%m%d') is not null end"""

_LATEST = f"""{_USABLE},
latest as (select * from (select *, row_number() over (partition by ticker, field order by t desc, period_end desc nulls last, fact_id desc nulls last, value desc) as r from good) where r = 1)"""

_SPIKES = f"""with {_BARS},
long as (
  select ticker, day, 'close' as measure, close as x from bars where close is not null
  union all select ticker, day, 'adj close', adj from bars where adj is not null
  union all select ticker, day, 'volume', volume from bars where volume is not null),
impossible as (select ticker, day, measure, x from long where isinf(x) or x < 0 or (x = 0 and measure <> 'volume')),
pos as (select *, ln(x) as l, row_number() over w as i from long where x > 0 and not isinf(x) window w as (partition by ticker, measure order by day)),
lagged as (select *, lag(l) over w as p1, lag(l, 2) over w as p2, lag(l, 3) over w as p3, lead(l) over w as n1, lead(l, 2) over w as n2, lead(l, 3) over w as n3,
  lag(x) over w as px, count(*) over (partition by ticker, measure) as n from pos window w as (partition by ticker, measure order by day)),
scale as (select ticker, measure, median(abs(l - p1)) filter (l <> p1) as s, sum(case when x = px then 1 else 0 end) as same, count(*) as n from lagged group by 1, 2),
j as (select g.*, 10 * s as k, 2 * same >= c.n as quiet from lagged g join scale c on g.ticker = c.ticker and g.measure = c.measure),
outlying as (select ticker, day, measure, x from j where
  (l - p1 > k and l - n1 > k)
  or (l - p1 > k and l - n2 > k and n1 - p1 > k and n1 - n2 > k)
  or (l - p2 > k and l - n1 > k and p1 - p2 > k and p1 - n1 > k)
  or (l - p1 > k and l - n3 > k and n1 - p1 > k and n1 - n3 > k and n2 - p1 > k and n2 - n3 > k)
  or (l - p2 > k and l - n2 > k and p1 - p2 > k and p1 - n2 > k and n1 - p2 > k and n1 - n2 > k)
  or (l - p3 > k and l - n1 > k and p1 - p3 > k and p1 - n1 > k and p2 - p3 > k and p2 - n1 > k)
  or (l - p1 < -k and l - n1 < -k)
  or (l - p1 < -k and l - n2 < -k and n1 - p1 < -k and n1 - n2 < -k)
  or (l - p2 < -k and l - n1 < -k and p1 - p2 < -k and p1 - n1 < -k)
  or (l - p1 < -k and l - n3 < -k and n1 - p1 < -k and n1 - n3 < -k and n2 - p1 < -k and n2 - n3 < -k)
  or (l - p2 < -k and l - n2 < -k and p1 - p2 < -k and p1 - n2 < -k and n1 - p2 < -k and n1 - n2 < -k)
  or (l - p3 < -k and l - n1 < -k and p1 - p3 < -k and p1 - n1 < -k and p2 - p3 < -k and p2 - n1 < -k)),
run as (select *, sum(case when px is null or x <> px then 1 else 0 end) over (partition by ticker, measure order by day) as r from j),
frozen as (select ticker, day, measure, x from (select *, count(*) over (partition by ticker, measure, r) as size, row_number() over (partition by ticker, measure, r order by day) as place from run) where size >= 6 and place > 1 and not quiet),
every as (select *, 1 as bit from impossible union all select *, 2 from outlying union all select *, 4 from frozen)"""

_PERIODS = f"""with rows as (
  select distinct {_TICKER.format('')} as ticker, coalesce(cast(start_date as date), date '0001-01-01') as s, coalesce(cast(end_date as date), date '2099-12-31') as e from membership),
ok as (select * from rows where ticker is not null and e > s),
head as (select *, case when s <= max(e) over (partition by ticker order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from ok),
grp as (select *, sum(new) over (partition by ticker order by s, e rows unbounded preceding) as g from head),
per as (select ticker, min(s) as s, max(e) as e from grp group by ticker, g),
gap as (select ticker, e as s, lead(s) over (partition by ticker order by s) as e from per)
select ticker, 'period' as kind, strftime(s, '%Y-%m-%d') as from_day, strftime(e, '%Y-%m-%d') as to_day from per
union all select ticker, 'gap', strftime(s, '%Y-%m-%d'), strftime(e, '%Y-%m-%d') from gap where e is not null"""


#: The columns of the wide table in the given tables (field_types), for the SQL only; the query reads the table.
_WIDE = {
    "book_equity": "double", "gross_profit": "double", "total_assets": "double", "revenue": "double", "cash": "double",
    "long_term_debt": "double", "dividend_per_share": "double", "backlog": "double", "shares_outstanding": "bigint", "employees": "bigint", "auditor_id": "bigint", "is_shell": "boolean", "is_seasoned": "boolean", "incorporated_on": "date",
}


def _wide_sql() -> str:
    cell = {
        "double": "l.value",
        "bigint": "case when l.value = floor(l.value) and l.value >= -9223372036854775808::double and l.value < 9223372036854775808::double then try_cast(l.value as bigint) end",
        "boolean": "case when l.value = 1 then true when l.value = 0 then false end",
        "date": "case when l.value = floor(l.value) and l.value between 10101 and 99991231 then cast(try_strptime(lpad(cast(try_cast(l.value as bigint) as varchar), 8, '0'), '%Y%m%d') as date) end",
    }
    columns = ", ".join(f"max({cell[kind]}) filter (l.field = '{f}') as {f}" for f, kind in _WIDE.items())
    return f"with {_LATEST}, every as (select distinct {_TICKER.format('')} as ticker from fundamentals) select e.ticker, {columns} from every e left join latest l on e.ticker = l.ticker where e.ticker is not null group by e.ticker"


SQL: dict[str, str] = {
    "p1_found": f"""{_CELLS}
select c.ticker, c.field, lpad(cast(c.q // 4 as varchar), 4, '0') || 'Q' || cast(c.q % 4 + 1 as varchar) as cal_quarter
from cells c where c.field in ('book_equity', 'total_assets') and not exists (select 1 from q where q.ticker = c.ticker and q.field = c.field and q.q = c.q)""",
    "p1_grid": f"""{_CELLS},
steps as (select *, lead(t) over (partition by ticker, field order by t) as u from q),
pieces as (select c.*, make_timestamp(cast(c.q // 4 as bigint), cast(c.q % 4 * 3 + 1 as bigint), 1, 0, 0, 0.0) as cs, make_timestamp(cast((c.q + 1) // 4 as bigint), cast((c.q + 1) % 4 * 3 + 1 as bigint), 1, 0, 0, 0.0) as ce,
  s.t, s.u, s.value, s.q = c.q as own from cells c join steps s on s.ticker = c.ticker and s.field = c.field and s.q <= c.q),
cut as (select *, epoch_us(least(coalesce(u, ce), ce)) - epoch_us(greatest(t, cs)) as us from pieces where u is null or u > cs)
select ticker, field, lpad(cast(q // 4 as varchar), 4, '0') || 'Q' || cast(q % 4 + 1 as varchar) as cal_quarter,
  arg_max(value, t) filter (own) as value, count(*) filter (own) = 0 as is_missing, arg_max(value, t) as filled_value, count(*) filter (own) as n_readings,
  case when abs(sum(value * us) / sum(us)) >= 1e8 then round(sum(value * us) / sum(us), -3) when abs(sum(value * us) / sum(us)) >= 1e4 then round(sum(value * us) / sum(us), 0) else round(sum(value * us) / sum(us), 6) end + 0.0 as time_weighted,
  round(case when arg_max(value, t) <> 0 then sum(value * us) / sum(us) / arg_max(value, t) end, 6) + 0.0 as mean_to_close,
  round(sum(us) / (epoch_us(any_value(ce)) - epoch_us(any_value(cs))), 6) as coverage
from cut group by ticker, field, q""",
    "p2_found": f"""with {_USABLE},
ev as (select distinct event_id, {_TICKER.format('')} as ticker, {_FIELD.format('')} as field, decided_at as t, case when not isnan(used_value) then used_value end as used_value from rebalances),
k as (select ev.*, inst.value as known_value from ev asof left join inst on ev.ticker = inst.ticker and ev.field = inst.field and ev.t >= inst.t)
select event_id from k where (used_value is null) <> (known_value is null) or (used_value <> known_value and abs(used_value - known_value) > 0.005)""",
    "p2_known": f"""with {_USABLE},
ev as (select distinct event_id, {_TICKER.format('')} as ticker, {_FIELD.format('')} as field, decided_at as t, case when not isnan(used_value) then used_value end as used_value from rebalances)
select ev.event_id, ev.ticker, ev.field, ev.used_value, inst.value as known_value, inst.fact_id as known_fact_id
from ev asof left join inst on ev.ticker = inst.ticker and ev.field = inst.field and ev.t >= inst.t""",
    "p3_found": f"""{_TRAILING}
select ticker, strftime(day, '%Y-%m-%d') as obs_day, case when f7 / 7 > 2.5 * (f30 / 30) then 'surge' else 'dry' end as kind
from roll where day >= a + 29 and (f7 / 7 > 2.5 * (f30 / 30) or f7 / 7 < 0.2 * (f30 / 30))""",
    "p3_trailing": f"""{_TRAILING}
select ticker, strftime(day, '%Y-%m-%d') as obs_day, round(f7, 2) as flow_sum_7, round(round(f7, 2) / 7, 4) as flow_avg_7, cast(n7 as integer) as price_n_7, round(round(s7, 4) / n7, 6) as price_avg_7,
  round(f30, 2) as flow_sum_30, round(round(f30, 2) / 30, 4) as flow_avg_30, cast(n30 as integer) as price_n_30, round(round(s30, 4) / n30, 6) as price_avg_30 from roll""",
    "p4_found": f"""with {_LATEST}
select l.ticker, l.field, l.fact_id from latest l join field_types f on l.field = f.field where {_TYPED}""",
    "p4_wide": _wide_sql(),
    "p5_found": f"""{_SPIKES}
select distinct ticker, strftime(day, '%Y-%m-%d') as obs_day, measure from every""",
    "p5_reasons": f"""{_SPIKES}
select ticker, strftime(day, '%Y-%m-%d') as obs_day, measure, x as value, cast(sum(bit) as integer) as reasons from (select distinct * from every) group by ticker, day, measure, x""",
    "p6_found": _PERIODS,
}
SQL["p1_grid_sharded"], SQL["p2_known_sharded"] = SQL["p1_grid"], SQL["p2_known"]
