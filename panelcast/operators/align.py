"""Alignment of price panels with indicator series on month.

Indicators carry no ticker. They are turned into ONE wide row per month
(one column per requested series) and joined to the long price panel on
``month``; that side holds at most one row per calendar month, and AQE
broadcasts it once the shuffle that builds it has measured its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import safe_name


def present_series(indicators: DataFrame, requested: Sequence[str],
                   key: str = "series_id") -> list[str]:
    """Requested ids that have data, in requested order.

    Collects at most ``len(requested)`` strings (a config list), never data.
    """
    found = {r[0] for r in (indicators.where(F.col(key).isin(list(requested)))
                                      .select(key).distinct().collect())}
    return [s for s in requested if s in found]


def missing_series(indicators: DataFrame, requested: Sequence[str],
                   key: str = "series_id") -> DataFrame:
    """Requested ids without any observation (left anti join)."""
    spark = indicators.sparkSession
    req = spark.createDataFrame([(s,) for s in requested], [key])
    have = indicators.select(key).distinct()
    return req.join(have, on=key, how="left_anti")


def pivot_series(long: DataFrame, ids: Sequence[str], key: str = "month",
                 series: str = "series_id", value: str = "value") -> DataFrame:
    """(series, key, value) -> one row per key, one column per id.

    The id list is explicit, so no job is run to discover pivot values.
    """
    wide = (long.where(F.col(series).isin(list(ids)))
                .groupBy(key).pivot(series, list(ids)).agg(F.first(value)))
    return wide.select(key, *[F.col(f"`{s}`").alias(safe_name(s)) for s in ids])


def align_inner(prices: DataFrame, indicators: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Inner join of prices with every (present) indicator on month.

    Equivalent to k chained inner merges followed by dropna, in one join.
    """
    wide = pivot_series(indicators, ids)
    cols = [safe_name(s) for s in ids]
    return prices.join(wide.dropna(how="any", subset=cols), on="month", how="inner")


def asof_expand(indicators: DataFrame, until: Column, key: str = "series_id",
                month: str = "month", value: str = "value") -> DataFrame:
    """Each observation covers its month up to the month before the next one.

    The last observation of a series stays valid up to ``until`` (stale
    series are carried forward). The window is per series and holds one row
    per observed month.
    """
    w = Window.partitionBy(key).orderBy(month)
    nxt = F.lead(month).over(w)
    upper = F.coalesce(F.add_months(nxt, -1), F.greatest(F.col(month), until))
    # bound first (a projection may hold a scalar subquery, a generator not)
    bounded = indicators.select(key, value, F.col(month).alias("_from"), upper.alias("_to"))
    return bounded.select(
        key, value, F.explode(F.sequence("_from", "_to",
                                         F.expr("INTERVAL 1 MONTH"))).alias(month))


def align_asof(prices: DataFrame, indicators: DataFrame, ids: Sequence[str],
               how: str = "left") -> DataFrame:
    """For each price month, the latest observation at or before it.

    Spark has no ASOF join; this is the equi-join form: expand each
    observation over its validity months, pivot, join on month. Series are
    carried to the last month of any of them, a scalar subquery over the
    indicators; later price months take the row of that month. So the trades
    behind ``prices`` are read once.
    """
    ind = indicators.where(F.col("series_id").isin(list(ids)))
    until = ind.select(F.max("month")).scalar()
    wide = pivot_series(asof_expand(ind, until), ids).withColumnRenamed("month", "_asof")
    keyed = prices.withColumn("_until", until).withColumn("_asof", F.least("month", "_until")).drop("_until")
    order = [*prices.columns, *[c for c in wide.columns if c != "_asof"]]
    return keyed.join(wide, on="_asof", how=how).select(*order)


SEGMENTS = 256  # parts of a series, in time


def _edges_below(edges: str, micros: Column, rows: DataFrame, out: str, most: int) -> DataFrame:
    """``out``: how many of a row's ascending ``edges`` (``most`` at most) lie below ``micros``.

    A binary search of one column a halving, so a row costs log2(``most``)
    comparisons in compiled code instead of ``most`` calls of a lambda.
    """
    rows = rows.withColumn(out, F.lit(0))
    for k in reversed(range(most.bit_length())):
        below = F.get(edges, F.col(out) + (2**k - 1)) < micros  # null beyond the last edge, or without edges
        rows = rows.withColumn(out, F.col(out) + F.when(below, 2**k).otherwise(0))
    return rows


def carry_last(df: DataFrame, by: str | None, ts: str, order: Sequence[str], value: str, out: str,
               segments: int = SEGMENTS) -> DataFrame:
    """D3 for rows at any times: ``out`` is the last ``value`` that isn't null at
    or before each row, by (``ts``, ``order``), within ``by`` (None: all rows are one series).

    A series is cut in time into segments of about equal rows (equal times stay
    together). Each segment's last value is carried over the segments' own short
    list and enters the segments after it as a row before all others; then values
    are carried inside the segments. So no task holds more of a series than a
    segment, and rows are sorted once.
    """
    keys = [by] if by else []
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = F.array(*[F.lit(k / segments) for k in range(1, segments)])
    edges = F.sort_array(F.percentile_approx(micros, cuts, 20 * segments)).alias("_edges")
    if by:
        edged = df.join(df.groupBy(F.col(by).alias("_by")).agg(edges), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    else:  # one list for all rows: no shuffle to join it
        edged = df.withColumn("_edges", df.select(edges).scalar())
    rows = _edges_below("_edges", micros, edged, "_segment", segments - 1).drop("_edges")
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_segment").agg(F.max_by(value, F.struct(ts, *order)).alias("_end"))
    # a segment's carry comes from the nearest earlier one that has a value: at most ``segments`` rows a series
    nxt = F.lead("_segment", 1, segments).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_segment"))
    spans = ends.select(*keys, "_end", (F.col("_segment") + 1).alias("_first"), nxt.alias("_upto"))
    carried = spans.select(*keys, F.col("_end").alias(value), F.explode(F.sequence("_first", F.greatest("_first", "_upto"))).alias("_segment"),
                           F.lit(False).alias("_given")).where(F.col("_segment") < segments)
    both = rows.withColumn("_given", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_segment").orderBy("_given", ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last(value, ignorenulls=True).over(inside)).where("_given").drop("_segment", "_given")


def asof_join(left: DataFrame, right: DataFrame, ts: str, values: Sequence[str], by: str | None = None,
              tie: Sequence[str] = (), segments: int = SEGMENTS) -> DataFrame:
    """J3 for any timestamps: every row of ``left`` with ``values`` of the last
    row of ``right`` at or before it (null: there is none), within ``by``.

    Both have the columns ``ts`` and ``by`` (without ``by``, one series). Among
    right rows of equal time the greatest ``tie`` counts. Right rows without a
    time or key are left out; left ones without match nothing. Left and right
    rows are merged in time and the values carried (``carry_last``), so a series
    that holds all rows is spread over many tasks.
    """
    keys = [F.col(by).alias("_key")] if by else []
    ties, cols = [f"_t{k}" for k in range(len(tie))], [f"_c{k}" for k in range(len(left.columns))]
    old = left.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
                      *[F.col(c).alias(name) for c, name in zip(left.columns, cols, strict=True)])
    new = right.where(F.col(ts).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True))).select(
        *keys, F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*values).alias("_value"),
        *[F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)])
    both = old.unionByName(new, allowMissingColumns=True)
    done = carry_last(both, "_key" if by else None, "_ts", ["_side", *ties], "_value", "_last", segments)
    return done.where(F.col("_side") == 1).select(*[F.col(name).alias(c) for c, name in zip(left.columns, cols, strict=True)],
                                               *[F.col(f"_last.{c}").alias(c) for c in values])


def shared_periods(panel: DataFrame, key: str = "ticker", month: str = "month",
                   value: str = "close") -> DataFrame:
    """J1 in long form: rows of the periods in which every entity has a value.

    Equal to chained inner joins of one column per entity, at any size of the
    universe: two counts by partial aggregation and a join on the period.
    """
    universe = panel.select(F.countDistinct(key)).scalar()
    full = (panel.where(F.col(value).isNotNull()).groupBy(month)
            .agg(F.countDistinct(key).alias("_n")).where(F.col("_n") == universe).select(month))
    return panel.join(full, on=month, how="left_semi")


def wide_by_entity(panel: DataFrame, entities: Sequence[str], key: str = "ticker",
                   month: str = "month", value: str = "close",
                   inner: bool = True, rename: bool = True) -> DataFrame:
    """One column per entity on month; ``inner`` keeps months all share.

    ``rename`` turns ids into column-safe names ('Brand#1' -> 'Brand_1');
    otherwise columns are named by the ids themselves.
    """
    wide = (panel.where(F.col(key).isin(list(entities)))
                 .groupBy(month).pivot(key, list(entities)).agg(F.first(value)))
    name = safe_name if rename else (lambda e: e)
    wide = wide.select(month, *[F.col(f"`{e}`").alias(name(e)) for e in entities])
    return wide.dropna(how="any") if inner else wide


def wide_to_long(wide: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
                 var_name: str = "series_id", value_name: str = "value") -> DataFrame:
    """Unpivot a wide table (one column per series) into long rows."""
    return wide.unpivot(list(id_cols), [F.col(f"`{c}`") for c in value_cols], var_name, value_name)


def wide_prices(panel: DataFrame, tickers: Sequence[str], key: str = "ticker",
                month: str = "month") -> DataFrame:
    """``{T}_Close`` / ``{T}_Volume`` columns per month (wide layout)."""
    return (panel.where(F.col(key).isin(list(tickers)))
                 .groupBy(month).pivot(key, list(tickers))
                 .agg(F.first("close").alias("Close"), F.first("volume").alias("Volume")))
