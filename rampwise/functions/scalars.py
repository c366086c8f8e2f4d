"""Column expressions: all built-in, all inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.functions.clock import SECOND, micros

METRES_PER_DEGREE = 111_320.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seconds_between(df: DataFrame, later: str, earlier: str) -> Column:
    """Fractional seconds from `earlier` to `later`, null if either is."""
    return (micros(df, later) - micros(df, earlier)) / SECOND


def first_known(*cols: Column | str) -> Column:
    return F.coalesce(*[_c(c) for c in cols])


def calendar(ts: str, prefix: str = "") -> list[Column]:
    """hour, day of week (0 = Sunday), month, year."""
    return [F.hour(ts).cast("long").alias(f"{prefix}hr"), (F.dayofweek(ts) - 1).cast("long").alias(f"{prefix}dow"),
            F.month(ts).cast("long").alias(f"{prefix}mon"), F.year(ts).cast("long").alias(f"{prefix}yr")]


def clip(x: Column | str, low: float, high: float) -> Column:
    """Null becomes a bound, as greatest and least skip nulls; gate nulls before."""
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def bin_by_edges(x: Column | str, edges: Sequence[float]) -> Column:
    """0 below the first edge, i below edge i, otherwise (and for null) the number of edges."""
    x = _c(x)
    out = F.when(x < edges[0], F.lit(0))
    for i, edge in enumerate(edges[1:], start=1):
        out = out.when(x < edge, F.lit(i))
    return out.otherwise(F.lit(len(edges))).cast("long")


def labelled_band(x: Column | str, bounds: Sequence[tuple[float, str]], rest: str) -> Column:
    """Label of the first bound that abs(x) does not exceed; null falls to `rest`."""
    x = F.abs(_c(x))
    first, *more = bounds
    out = F.when(x <= first[0], first[1])
    for limit, label in more:
        out = out.when(x <= limit, label)
    return out.otherwise(rest)


def parse_sentinel(x: Column | str, tokens: Mapping[str, float | None]) -> Column:
    """Number in text; a token stands for its value, any other text for null."""
    x = _c(x)
    out = F.expr("CAST(NULL AS DOUBLE)")
    parsed = x.try_cast("double")
    if not tokens:
        return parsed
    pairs = iter(tokens.items())
    token, value = next(pairs)
    out = F.when(x == token, F.lit(value).cast("double"))
    for token, value in pairs:
        out = out.when(x == token, F.lit(value).cast("double"))
    return out.otherwise(parsed)


def parse_instant(x: Column | str, pattern: str) -> Column:
    """Timestamp from text under a UTC session; null where the text does not fit."""
    return F.try_to_timestamp(_c(x), F.lit(pattern))


def coded_flag(x: Column | str, tokens: Sequence[str]) -> Column:
    """Whether the coded text holds any of the tokens; null stays null."""
    x = _c(x)
    return reduce(lambda a, b: a | b, [x.contains(t) for t in tokens])


def flag(condition: Column) -> Column:
    """Condition as 0/1, null stays null."""
    return condition.cast("int").cast("long")


def null_if_stale(df: DataFrame, age: Column, limit: float, columns: Sequence[str], low: float | None = None) -> DataFrame:
    """Keep `columns` only where age <= limit (and age >= low)."""
    fresh = age <= limit
    if low is not None:
        fresh = fresh & (age >= low)
    gated = set(columns)
    return df.select(*[F.when(fresh, F.col(c)).alias(c) if c in gated else F.col(c) for c in df.columns])


def minutes_crossed(later: Column | str, earlier: Column | str) -> Column:
    """Minute boundaries between two instants in microseconds."""
    minute = 60 * SECOND
    start = lambda c: c - F.pmod(c, F.lit(minute))
    return ((start(_c(later)) - start(_c(earlier))) / minute).cast("long")


def capped(x: Column | str, cap: float) -> Column:
    """least(x, cap): a null x reads as the cap."""
    return F.least(_c(x), F.lit(cap).cast("double"))


def normalise(x: Column | str) -> Column:
    return F.upper(F.trim(_c(x)))


def key_part(x: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group; '' where the pattern does not match, null for null."""
    return F.regexp_extract(_c(x), pattern, group)


ALPHA_PREFIX = r"^([A-Z]{3})"
DESIGNATOR = r"^([A-Z0-9]{2}[A-Z]?)[0-9]"
TRAILING_NUMBER = r"([0-9]+[A-Z]*)$"


def guessed_key(prefix: Column | str, text: Column | str) -> Column:
    """Learned prefix followed by the trailing number; null without a prefix."""
    return F.concat(_c(prefix), key_part(text, TRAILING_NUMBER))


def planar_metres(lat1, lon1, lat2, lon2) -> Column:
    """Flat distance, longitude scaled at the first point."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    north = (lat1 - lat2) * METRES_PER_DEGREE
    east = (lon1 - lon2) * METRES_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(F.pow(north, F.lit(2)) + F.pow(east, F.lit(2)))


def site_of(lat: Column | str, lon: Column | str, sites: Mapping[str, tuple[float, float]],
            dlat: float = 0.06, dlon: float = 0.09) -> Column:
    """First site whose box holds the point; null outside all."""
    lat, lon = _c(lat), _c(lon)
    out = None
    for name, (la, lo) in sites.items():
        inside = (F.abs(lat - la) <= dlat) & (F.abs(lon - lo) <= dlon)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_c(a), _c(b))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation over the pairs that are complete; null where a side does not vary."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def category(x: Column | str, missing: str = "__NA__") -> Column:
    """Explicit token for a missing category."""
    return F.coalesce(_c(x).cast("string"), F.lit(missing))


def presence(x: Column | str) -> Column:
    return flag(_c(x).isNotNull())
