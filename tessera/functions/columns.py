"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock, whatever the session's time zone."""
    t = col(ts)
    day = F.unix_date(t.cast("date")).cast("long") * F.lit(86_400_000_000)
    clock = F.hour(t).cast("long") * F.lit(3_600_000_000) + F.minute(t).cast("long") * F.lit(60_000_000)
    return day + clock + (F.extract(F.lit("SECONDS"), t) * F.lit(1_000_000)).cast("long")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_given(*cs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*map(blank_to_null, cs))


def digest(*cs: Column | str, sep: str = "\x1f") -> Column:
    """SHA-256 of the parts' texts with a separator that texts don't contain; null counts as empty."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cs]).cast("binary"), 256)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where there is nothing to share."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def upper_index(n: Column, q: float) -> Column:
    """0-based index ceil((n - 1) * q) in sorted order: a quantile that is always one of the values."""
    return F.ceil((n - 1) * F.lit(q)).cast("long")
