"""Column picking and the symbol rules that all operators share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as blank at either end of a ticker or field.
BLANKS = " \t\n\r\x0b\x0c\u00a0"
DAY_US = 86_400_000_000


def pick(df: DataFrame, columns: Mapping[str, str], optional: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """Columns of df under new names: {new: old}.

    The exact spelling wins, then the first column that differs in case only, so extra columns with clashing names
    (also repeated ones) neither make a reference ambiguous nor reach the plan. Names in ``optional`` may be absent
    and are NULL then; any other absent column raises KeyError.
    """
    names = df.columns
    folded = [n.lower() for n in names]
    flat = df.toDF(*(f"_c{i}" for i in range(len(names))))
    out = []
    for new, old in columns.items():
        if old in names:
            out.append(F.col(f"_c{names.index(old)}").alias(new))
        elif old.lower() in folded:
            out.append(F.col(f"_c{folded.index(old.lower())}").alias(new))
        elif new in optional:
            out.append(F.lit(None).alias(new))
        else:
            raise KeyError(f"no column {old!r} among {names}")
    return flat.select(*out)


def symbol(c: Column | str) -> Column:
    """Ticker form: trimmed, upper case, '.' read as '-'; blank is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.translate(F.upper(F.btrim(c, F.lit(BLANKS))), ".", "-"), F.lit(""))


def field_name(c: Column | str) -> Column:
    """Field form: trimmed, lower case, blanks and hyphens read as '_'; blank is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.translate(F.lower(F.btrim(c, F.lit(BLANKS))), " -", "__"), F.lit(""))


def named(c: Column | str) -> Column:
    """True where symbol() and field_name() are not NULL; cheaper as a filter than either, so that generated code stays small."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(BLANKS)) != ""


def present(c: Column | str) -> Column:
    """Double with NaN read as NULL."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def day_number(c: Column | str) -> Column:
    """Days since 1970-01-01 of a date or timestamp, whatever the session's zone does to clock times."""
    return F.unix_date(F.to_date(c))


def micros(c: Column | str) -> Column:
    """Microseconds of the wall clock since 1970-01-01; the same for zoned and zoneless timestamps."""
    c = F.col(c) if isinstance(c, str) else c
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * F.lit(1_000_000).cast("long")
    return day_number(c).cast("long") * F.lit(DAY_US).cast("long") + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def day_of(us: Column | str) -> Column:
    """Day number of microseconds since 1970-01-01, in whole numbers."""
    us = F.col(us) if isinstance(us, str) else us
    d = F.lit(DAY_US).cast("long")
    return ((us - F.pmod(us, d)) / d).cast("int")


def quarter_of(us: Column | str) -> Column:
    """Quarters since year 0 of microseconds since 1970-01-01."""
    day = F.date_from_unix_date(day_of(us))
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_start_us(q: Column) -> Column:
    return F.unix_date(F.make_date(F.floor(q / 4).cast("int"), (F.pmod(q, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))).cast("long") * F.lit(DAY_US).cast("long")


def quarter_label(q: Column) -> Column:
    return F.concat(F.lpad(F.floor(q / 4).cast("string"), 4, "0"), F.lit("Q"), (F.pmod(q, F.lit(4)) + 1).cast("string"))


def day_label(c: Column) -> Column:
    """yyyy-MM-dd of a day number."""
    return F.date_format(F.date_from_unix_date(c.cast("int")), "yyyy-MM-dd")

