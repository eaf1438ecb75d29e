"""Scalar column helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col, digits: int = 4) -> Column:
    """numpy-style rounding: scale, round half to even, unscale.

    ``pandas.Series.round`` works this way (0.00005 -> 0.0); Spark's
    ``round`` is half-up and ``bround`` rounds the shortest decimal string,
    which differ from it on binary ties.
    """
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def pct_change(new, base) -> Column:
    """(new - base) / base * 100; NULL when base is 0 or NULL."""
    return F.try_divide(_c(new) - _c(base), _c(base)) * F.lit(100.0)


def nan_to_null(col) -> Column:
    """pandas treats NaN as missing; Spark does not. Normalise at ingestion."""
    c = _c(col)
    return F.when(~F.isnan(c), c)


def to_double(col) -> Column:
    """Lenient numeric coercion: unparsable text (e.g. '.') becomes NULL."""
    return nan_to_null(_c(col).cast("string").try_cast("double"))


_SEQ_SPAN = "10000000000000000000"  # 10^19 > any non-negative long


def order_key(ts, seq) -> Column:
    """Exact total order of (timestamp, non-negative long seq) as one
    DECIMAL(38,0): unix_micros(ts) * 10^19 + seq.

    A single decimal keeps ``max_by`` / ``min_by`` on the hash aggregate
    path (a struct key forces sort-based aggregation), with no loss: the
    17 + 19 digits fit in 38.
    """
    dec = DecimalType(38, 0)
    micros = F.unix_micros(_c(ts).cast("timestamp")).cast(dec)
    return micros * F.lit(_SEQ_SPAN).cast(dec) + _c(seq).cast(dec)


def month_start(col) -> Column:
    """First day of the month of a date/timestamp, as DATE."""
    return F.trunc(F.to_date(_c(col)), "month")


def safe_name(series_id: str) -> str:
    """Column-safe name for a series id ('1-URGENT' -> 's_1_URGENT')."""
    name = re.sub(r"[^0-9A-Za-z]+", "_", series_id).strip("_")
    if not name or name[0].isdigit():
        name = "s_" + name
    return name
