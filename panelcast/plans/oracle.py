"""Independent SQL (DuckDB dialect) for the registered queries.

The driver runs these next to the Spark plans on the same parquet tables.
The SQL is written from the operator definitions (not generated from the
Spark plans); small builders below only avoid repeating the shared CTEs
(prices, indicators, features, split, OLS, backtest).
"""

from __future__ import annotations

from collections.abc import Sequence

from panelcast.functions import stats
from panelcast.functions.numeric import safe_name
from panelcast.plans.catalog import (DRIFT_DAYS, DRIFT_REF_END, REQUESTED, SLICE, WIDE_TICKERS,
                                     TEST_EXPERIMENTS, TEST_SERIES)

ALL = list(TEST_SERIES)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def rnd(expr: str, digits: int = 4) -> str:
    scale = float(10 ** digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def exact_mean(col: str, window: str | None = None) -> str:
    over = f" OVER {window}" if window else ""
    return (f"(CAST(sum(CAST({col} AS DECIMAL(18,4))){over} AS DOUBLE) / "
            f"CAST(count({col}){over} AS DOUBLE))")


def comoment(x: str, y: str, window: str | None = None) -> str:
    over = f" OVER {window}" if window else ""
    # DECIMAL(38,4) operands: DuckDB does not widen DECIMAL(18) products itself
    dx, dy = f"CAST({x} AS DECIMAL(38,4))", f"CAST({y} AS DECIMAL(38,4))"
    return (f"CAST(count({dx}){over} * sum({dx} * {dy}){over} - "
            f"sum({dx}){over} * sum({dy}){over} AS DOUBLE)")


# --- shared CTEs ----------------------------------------------------------------

def ticks_cte(start: str | None = None, end: str | None = None) -> str:
    cond = []
    if start:
        cond.append(f"l_shipdate >= TIMESTAMP '{start[:7]}-01'")
    if end:
        y, m = int(end[:4]), int(end[5:7])
        y2, m2 = (y + 1, 1) if m == 12 else (y, m + 1)
        cond.append(f"l_shipdate < TIMESTAMP '{y2:04d}-{m2:02d}-01'")
    where = (" WHERE " + " AND ".join(cond)) if cond else ""
    return f"""ticks AS (
  SELECT p_brand AS ticker, l_shipdate AS ts, l_orderkey AS seq_a, l_linenumber AS seq_b,
         l_extendedprice AS price, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey{where})"""


def prices_cte(start=None, end=None, tickers: Sequence[str] | None = None) -> str:
    where = f" WHERE ticker IN {_in(tickers)}" if tickers else ""
    return ticks_cte(start, end) + f""",
prices AS (
  SELECT ticker, CAST(date_trunc('month', ts) AS DATE) AS month,
         {rnd("arg_max(price, (ts, seq_a, seq_b))")} AS close,
         sum(qty) AS volume
  FROM ticks{where} GROUP BY ALL)"""


def ind_cte(unit: str = "month", name: str = "ind") -> str:
    return f"""{name} AS (
  SELECT o_orderpriority AS series_id,
         CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS month,
         {exact_mean("o_totalprice")} AS value,
         count(o_totalprice) AS n_obs
  FROM orders GROUP BY ALL)"""


def wide_cte(src: str, ids: Sequence[str], name: str, key: str = "month") -> str:
    cols = ",\n         ".join(
        f"max(CASE WHEN series_id = {_q(s)} THEN value END) AS {safe_name(s)}" for s in ids)
    return f"""{name} AS (
  SELECT {key},
         {cols}
  FROM {src} WHERE series_id IN {_in(ids)} GROUP BY {key})"""


def panel_inner_cte(ids: Sequence[str], tickers=None) -> str:
    cols = [safe_name(s) for s in ids]
    nn = " AND ".join(f"w.{c} IS NOT NULL" for c in cols)
    sel = ", ".join(f"w.{c}" for c in cols)
    return (prices_cte(tickers=tickers) + ",\n" + ind_cte() + ",\n" + wide_cte("ind", ids, "ind_wide")
            + f""",
panel AS (
  SELECT p.month, p.ticker, p.close, p.volume, {sel}
  FROM prices p JOIN ind_wide w ON p.month = w.month WHERE {nn})""")


def panel_asof_cte(ids: Sequence[str]) -> str:
    cols = [safe_name(s) for s in ids]
    piv = ",\n         ".join(
        f"max(CASE WHEN series_id = {_q(s)} THEN value END) AS {safe_name(s)}" for s in ids)
    sel = ", ".join(f"w.{c}" for c in cols)
    return (prices_cte() + ",\n" + ind_cte("quarter", "qind") + f""",
qser AS (SELECT DISTINCT series_id FROM qind WHERE series_id IN {_in(ids)}),
pg AS (SELECT p.ticker, p.month, s.series_id FROM prices p CROSS JOIN qser s),
asof_long AS (
  SELECT pg.ticker, pg.month, pg.series_id, q.value
  FROM pg ASOF LEFT JOIN qind q ON pg.series_id = q.series_id AND pg.month >= q.month),
asof_wide AS (
  SELECT ticker, month,
         {piv}
  FROM asof_long GROUP BY ticker, month),
panel AS (
  SELECT p.month, p.ticker, p.close, p.volume, {sel}
  FROM prices p LEFT JOIN asof_wide w ON p.ticker = w.ticker AND p.month = w.month)""")


W = "(PARTITION BY ticker ORDER BY month)"


def frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ma_sql(col: str, n: int) -> str:
    f = frame(n)
    return f"CASE WHEN count({col}) OVER {f} = {n} THEN {exact_mean(col, f)} END AS {col}_ma{n}"


def vol_sql(col: str, n: int = 3) -> str:
    f = frame(n)
    cnt = f"count({col}) OVER {f}"
    var = f"{comoment(col, col, f)} / CAST({cnt} * ({cnt} - 1) AS DOUBLE)"
    return f"CASE WHEN count({col}) OVER {f} = {n} THEN sqrt({var}) END AS {col}_volatility"


def features_cte(base_cols: Sequence[str], lag_cols: Sequence[str], lags=(1, 3, 6),
                 mas=(3, 12), volatility=True, warmup="drop", src="panel",
                 name="ft") -> tuple[str, list[str]]:
    derived_exprs = [ma_sql("close", m) for m in mas]
    derived = [f"close_ma{m}" for m in mas]
    if volatility:
        derived_exprs.append(vol_sql("close"))
        derived.append("close_volatility")
    for c in lag_cols:
        for k in lags:
            derived_exprs.append(f"lag({c}, {k}) OVER {W} AS {c}_lag{k}")
            derived.append(f"{c}_lag{k}")
    cols = list(base_cols) + derived
    raw = f"""{name}_raw AS (
  SELECT {", ".join(base_cols)},
         {(",\n         ").join(derived_exprs)}
  FROM {src})"""
    if warmup == "drop":
        nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        return raw + f",\n{name} AS (SELECT * FROM {name}_raw WHERE {nn})", cols
    fill = ", ".join(
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY month "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}" for c in derived)
    return raw + f",\n{name} AS (SELECT {', '.join(base_cols)}, {fill} FROM {name}_raw)", cols


def e1_features(ids=ALL, tickers=None, name="ft") -> str:
    cols = [safe_name(s) for s in ids]
    base = ["month", "ticker", "close", "volume", *cols]
    ft, _ = features_cte(base, ["volume", *cols], name=name)
    return panel_inner_cte(ids, tickers) + ",\n" + ft


def sup_cte(h: int, src: str = "ft", name: str = "sup") -> str:
    return f"""{name}_y AS (
  SELECT *, lead(close, {h}) OVER {W} AS y FROM {src}),
{name}_n AS (
  SELECT *, CAST(row_number() OVER {W} AS INTEGER) AS rn,
         count(*) OVER (PARTITION BY ticker) AS n
  FROM {name}_y WHERE y IS NOT NULL),
{name} AS (
  SELECT *, rn > n - CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(n AS DOUBLE)) AS BIGINT) AS is_test
  FROM {name}_n)"""


def ols_cte(sup: str = "sup", x: str = "close", name: str = "scored") -> str:
    return f"""{name}_m AS (
  SELECT ticker, {comoment(x, "y")} AS sxy, {comoment(x, x)} AS sxx,
         CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) AS sx,
         CAST(sum(CAST(y AS DECIMAL(18,4))) AS DOUBLE) AS sy, count(*) AS n_train
  FROM {sup} WHERE NOT is_test GROUP BY ticker),
{name}_c AS (
  SELECT ticker, coalesce(CASE WHEN sxx <> 0 THEN sxy / sxx END, 0.0) AS slope, sx, sy, n_train
  FROM {name}_m),
{name}_c2 AS (
  SELECT ticker, slope, (sy - slope * sx) / CAST(n_train AS DOUBLE) AS intercept FROM {name}_c),
{name} AS (
  SELECT s.*, c.intercept + c.slope * s.{x} AS predicted
  FROM {sup} s JOIN {name}_c2 c ON s.ticker = c.ticker)"""


def signal_sql(pred: str = "predicted", cur: str = "close", neutral: str = "Hold") -> str:
    chg = f"(CASE WHEN {cur} = 0 THEN NULL ELSE ({pred} - {cur}) / {cur} * 100.0 END)"
    return (f"CASE WHEN {chg} > 5.0 THEN 'Buy' WHEN {chg} < -5.0 THEN 'Sell' "
            f"ELSE {_q(neutral)} END")


def backtest_cte(scored: str, h: int, name: str = "bt", model: str = "OLS") -> str:
    return f"""{name} AS (
  SELECT ticker, {_q(model)} AS model, CAST({h} AS INTEGER) AS horizon, month AS date,
         y AS actual, predicted, close AS current_price, {signal_sql()} AS signal
  FROM {scored} WHERE is_test)"""


def ols_backtest(h: int = 1, ids=ALL, tickers=None) -> str:
    return (e1_features(ids, tickers) + ",\n" + sup_cte(h) + ",\n" + ols_cte() + ",\n"
            + backtest_cte("scored", h))


def metrics_sql(bt: str = "bt") -> str:
    err = "(actual - predicted)"
    ss_res = f"sum({err} * {err})"
    ss_tot = "(var_pop(actual) * count(actual))"
    r2 = (f"CASE WHEN {ss_tot} = 0 THEN (CASE WHEN {ss_res} = 0 THEN 1.0 ELSE 0.0 END) "
          f"ELSE 1.0 - {ss_res} / {ss_tot} END")
    return f"""SELECT ticker, model, horizon,
       {rnd(f"sqrt(avg({err} * {err}))")} AS rmse,
       {rnd(f"avg(abs({err}))")} AS mae,
       {rnd(r2)} AS r2,
       count(*) AS n
FROM {bt} GROUP BY ticker, model, horizon"""


def grid_cte() -> str:
    return prices_cte() + """,
span AS (SELECT ticker, min(month) AS lo, max(month) AS hi FROM prices GROUP BY ticker),
grid AS (
  SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM span),
g AS (
  SELECT grid.ticker, grid.month, p.close, p.volume
  FROM grid LEFT JOIN prices p ON grid.ticker = p.ticker AND grid.month = p.month)"""


# --- the queries --------------------------------------------------------------------

SQL: dict[str, str] = {}

SQL["monthly_price_bars"] = f"WITH {prices_cte()}\nSELECT * FROM prices"

SQL["monthly_indicator_mean"] = f"WITH {ind_cte()}\nSELECT * FROM ind"

SQL["observations_json_flatten"] = """WITH e AS (
  SELECT event_id AS obs_id, event_type AS series_id, CAST(ts AS DATE) AS day, props,
         unnest(json_keys(props)) AS field
  FROM events)
SELECT obs_id, series_id, day, field,
       TRY_CAST(json_extract_string(props, '$."' || field || '"') AS DOUBLE) AS value
FROM e"""

SQL["numeric_coercion"] = """SELECT event_id AS obs_id,
       json_extract_string(props, '$.k') AS raw,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value,
       TRY_CAST(event_type AS DOUBLE) AS series_as_number
FROM events"""

SQL["first_per_month"] = f"""WITH {ticks_cte()}
SELECT ticker, CAST(date_trunc('month', ts) AS DATE) AS month, ts, price, qty
FROM ticks
QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', ts)
                           ORDER BY ts, seq_a, seq_b) = 1"""

SQL["duplicate_month_check"] = f"""WITH {ticks_cte()}
SELECT ticker, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n_rows
FROM ticks GROUP BY ALL HAVING count(*) > 1"""

SQL["missing_series_report"] = f"""SELECT s AS series_id
FROM (VALUES {", ".join(f"({_q(s)})" for s in REQUESTED)}) t(s)
WHERE s NOT IN (SELECT DISTINCT o_orderpriority FROM orders)"""

SQL["forward_fill"] = f"""WITH {grid_cte()}
SELECT ticker, month, close,
       last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY month
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close_ffill
FROM g"""

SQL["back_fill"] = f"""WITH {grid_cte()}
SELECT ticker, month, close,
       first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY month
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close_bfill
FROM g"""

SQL["null_counts"] = f"""WITH {grid_cte()}
SELECT ticker, count(*) AS n_rows,
       CAST(count_if(close IS NULL) AS BIGINT) AS close_missing,
       CAST(count_if(volume IS NULL) AS BIGINT) AS volume_missing
FROM g GROUP BY ticker"""

SQL["align_inner"] = f"WITH {panel_inner_cte(ALL)}\nSELECT * FROM panel"

SQL["align_asof"] = f"WITH {panel_asof_cte(ALL)}\nSELECT * FROM panel"

SQL["wide_pivot"] = f"""WITH {prices_cte()},
full_months AS (
  SELECT month FROM prices WHERE close IS NOT NULL GROUP BY month
  HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM prices))
SELECT p.month, p.ticker, p.close FROM prices p JOIN full_months f ON p.month = f.month"""

SQL["wide_unpivot"] = f"WITH {ind_cte()},\n{wide_cte('ind', ALL, 'ind_wide')}\n" + "\nUNION ALL\n".join(
    f"SELECT month, {_q(safe_name(s))} AS series_id, {safe_name(s)} AS value FROM ind_wide" for s in ALL)

SQL["range_slice"] = f"WITH {prices_cte(*SLICE)}\nSELECT * FROM prices"

SQL["drop_missing"] = (f"WITH {grid_cte()},\n{ind_cte()},\n{wide_cte('ind', ALL, 'ind_wide')}\n"
                       f"SELECT g.*, " + ", ".join(f"w.{safe_name(s)}" for s in ALL)
                       + "\nFROM g LEFT JOIN ind_wide w ON g.month = w.month\nWHERE "
                       + " AND ".join(f"{c} IS NOT NULL" for c in
                                      ["g.close", "g.volume", *[f"w.{safe_name(s)}" for s in ALL]]))

SQL["prefix_split"] = f"""WITH {ols_backtest()},
m AS ({metrics_sql()})
SELECT ticker || '_' || model AS run_name, horizon, ticker, model FROM m"""

_ind_cols = [safe_name(s) for s in ALL]
SQL["lag_features"] = (f"WITH {panel_inner_cte(ALL)}\nSELECT ticker, month, "
                       + ", ".join(f"lag({c}, {k}) OVER {W} AS {c}_lag{k}"
                                   for c in ["volume", *_ind_cols] for k in (1, 3, 6))
                       + "\nFROM panel")

SQL["lead_target"] = f"""WITH {prices_cte()},
t AS (SELECT ticker, month, close, lead(close, 1) OVER {W} AS y FROM prices)
SELECT * FROM t WHERE y IS NOT NULL"""

SQL["moving_average"] = (f"WITH {prices_cte()}\nSELECT ticker, month, close, {ma_sql('close', 3)}, "
                         f"{ma_sql('close', 12)}\nFROM prices")

SQL["rolling_volatility"] = (f"WITH {prices_cte()}\nSELECT ticker, month, close, {vol_sql('close')}"
                             "\nFROM prices")

SQL["feature_table"] = f"WITH {e1_features()}\nSELECT * FROM ft"

_gold_base = ["month", "ticker", "close", "volume", *_ind_cols]
_gold_ft, _ = features_cte(_gold_base, ["close", *_ind_cols], volatility=False,
                           warmup="backfill")
SQL["feature_table_backfilled"] = f"WITH {panel_asof_cte(ALL)},\n{_gold_ft}\nSELECT * FROM ft"

SQL["lagged_comparison"] = (f"WITH {panel_inner_cte(ALL)}\nSELECT ticker, month, close, "
                            + ", ".join(f"lag({c}, 3) OVER {W} AS {c}_lag3" for c in _ind_cols)
                            + "\nFROM panel")

# every numeric feature column, in the feature table's column order
_ft_cols = (["close", "volume", *_ind_cols, "close_ma3", "close_ma12", "close_volatility"]
            + [f"{c}_lag{k}" for c in ["volume", *_ind_cols] for k in (1, 3, 6)])


def _corr_sql() -> str:
    from itertools import combinations_with_replacement
    entries = []
    for a, b in combinations_with_replacement(_ft_cols, 2):
        r = f"corr({a}, {b})"
        r = rnd(f"CASE WHEN isnan({r}) THEN NULL ELSE {r} END")
        entries.append(f"{{'col_a': {_q(a)}, 'col_b': {_q(b)}, 'r': {r}}}")
        if a != b:
            entries.append(f"{{'col_a': {_q(b)}, 'col_b': {_q(a)}, 'r': {r}}}")
    return (f"WITH {e1_features()},\n"
            f"m AS (SELECT ticker, [{', '.join(entries)}] AS l FROM ft GROUP BY ticker)\n"
            "SELECT ticker, unnest(l, recursive := true) FROM m")


SQL["correlation_matrix"] = _corr_sql()

SQL["chrono_split"] = f"WITH {e1_features()},\n{sup_cte(1)}\nSELECT ticker, month, rn, n, is_test FROM sup"


def _scaler_select(src: str = "sup") -> str:
    parts = []
    for c in ("close", "volume", "y"):
        v = f"(CASE WHEN NOT is_test THEN {c} END)"
        std = f"sqrt({comoment(v, v)} / CAST(count({v}) * count({v}) AS DOUBLE))"
        parts.append(f"{exact_mean(v)} AS {c}_mean")
        parts.append(f"CASE WHEN {std} = 0 THEN 1.0 ELSE {std} END AS {c}_std")
    return f"SELECT ticker, {', '.join(parts)} FROM {src} GROUP BY ticker"


SQL["train_scaler"] = f"WITH {e1_features()},\n{sup_cte(1)}\n{_scaler_select()}"

SQL["target_scaling_roundtrip"] = f"""WITH {e1_features()},
{sup_cte(1)},
st AS ({_scaler_select()}),
sc AS (SELECT s.ticker, s.month, s.y, (s.y - st.y_mean) / st.y_std AS y_scaled, st.y_mean, st.y_std
       FROM sup s JOIN st ON s.ticker = st.ticker)
SELECT ticker, month, y, y_scaled, {rnd("y_scaled * y_std + y_mean")} AS y_back FROM sc"""

SQL["ols_forecast"] = (f"WITH {e1_features()},\n{sup_cte(1)},\n{ols_cte()}\n"
                       "SELECT ticker, month, close, y, predicted FROM scored WHERE is_test")

SQL["backtest_signals"] = f"WITH {ols_backtest()}\nSELECT * FROM bt"

SQL["signal_counts"] = f"WITH {ols_backtest()}\nSELECT ticker, model, signal, count(*) AS n FROM bt GROUP BY ALL"

SQL["buy_sell_markers"] = (f"WITH {ols_backtest()}\nSELECT ticker, model, horizon, date, actual, predicted, signal "
                           "FROM bt WHERE signal IN ('Buy', 'Sell')")

SQL["metrics_summary"] = f"WITH {ols_backtest()}\n{metrics_sql()}"

SQL["top_models"] = (f"WITH {ols_backtest()},\nm AS ({metrics_sql()})\n"
                     "SELECT * FROM m ORDER BY r2 DESC NULLS LAST, ticker, horizon LIMIT 10")

SQL["bias_directional"] = f"""WITH {ols_backtest()},
bp AS (SELECT *, lag(actual) OVER (PARTITION BY ticker, model, horizon ORDER BY date) AS prev FROM bt)
SELECT ticker, model, horizon,
       {rnd("avg(predicted - actual)")} AS bias,
       {rnd("avg(CASE WHEN prev IS NULL THEN NULL ELSE CAST(sign(predicted - prev) = sign(actual - prev) AS DOUBLE) END)")}
         AS directional_accuracy
FROM bp GROUP BY ticker, model, horizon"""

SQL["bias_correction"] = f"""WITH {e1_features()},
{sup_cte(1)},
b AS (SELECT ticker, avg(CASE WHEN NOT is_test THEN close_ma3 - y END) AS train_bias
      FROM sup GROUP BY ticker)
SELECT s.ticker, s.month, s.y, {rnd("b.train_bias")} AS train_bias,
       {rnd("s.close_ma3 - coalesce(b.train_bias, 0.0)")} AS predicted
FROM sup s LEFT JOIN b ON s.ticker = b.ticker WHERE s.is_test"""

SQL["horizon_grid"] = (f"WITH {e1_features()},\n{sup_cte(1, 'ft', 'sup1')},\n{ols_cte('sup1', name='sc1')},\n"
                       f"{backtest_cte('sc1', 1, 'bt1')},\n{sup_cte(3, 'ft', 'sup3')},\n"
                       f"{ols_cte('sup3', name='sc3')},\n{backtest_cte('sc3', 3, 'bt3')},\n"
                       f"bt AS (SELECT * FROM bt1 UNION ALL SELECT * FROM bt3)\n{metrics_sql()}")


def _experiment_sql() -> str:
    parts = []
    for exp in TEST_EXPERIMENTS:
        ids = list(exp.indicators)
        q = ols_backtest(1, ids, exp.tickers)
        parts.append(f"SELECT {_q(exp.name)} AS experiment, * FROM (WITH {q}\n{metrics_sql()})")
    return "\nUNION ALL\n".join(parts)


SQL["experiment_suite"] = _experiment_sql()

def _ks_sql(current_start: str) -> str:
    return f"""WITH d AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS day, value FROM events WHERE value IS NOT NULL),
lt AS (SELECT series_id, max(day) AS latest FROM d GROUP BY series_id),
t AS (
  SELECT d.series_id, d.value AS v,
         CAST(d.day <= DATE '{DRIFT_REF_END}' AS BIGINT) AS c_ref,
         CAST(d.day >= {current_start} AND d.day <= lt.latest AS BIGINT) AS c_cur
  FROM d JOIN lt ON d.series_id = lt.series_id),
c AS (
  SELECT series_id, v, sum(c_ref) AS c_ref, sum(c_cur) AS c_cur FROM t GROUP BY series_id, v
  HAVING sum(c_ref) > 0 OR sum(c_cur) > 0),
cum AS (
  SELECT series_id,
         sum(c_ref) OVER (PARTITION BY series_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
         sum(c_cur) OVER (PARTITION BY series_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc,
         sum(c_ref) OVER (PARTITION BY series_id) AS n_ref,
         sum(c_cur) OVER (PARTITION BY series_id) AS n_cur
  FROM c)
SELECT series_id, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
       max(abs(CAST(cr AS DOUBLE) / CAST(n_ref AS DOUBLE) - CAST(cc AS DOUBLE) / CAST(n_cur AS DOUBLE)))
         AS ks_statistic
FROM cum GROUP BY series_id, n_ref, n_cur"""


def _ks_verdict_sql(current_start: str, columns: str) -> str:
    return f"""WITH k AS ({_ks_sql(current_start)}),
v AS (
  SELECT *, CASE WHEN n_cur >= 6 AND n_ref > 0 THEN ks_statistic END AS d,
         sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * ks_statistic AS x FROM k),
p AS (
  SELECT *, CASE WHEN d IS NULL THEN NULL WHEN x <= 0 THEN 1.0
    WHEN x < 1 THEN 1 - sqrt(2 * pi()) / x * list_sum(list_transform(range(1, 21), lambda k:
      exp(-((2 * k - 1) * (2 * k - 1)) * pi() * pi() / (8 * x * x))))
    ELSE 2 * list_sum(list_transform(range(1, 21), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * x * x)))
    END AS raw FROM v),
res AS (
  SELECT series_id, n_ref, n_cur, d AS ks_statistic, round(greatest(0.0, least(1.0, raw)), 10) AS p_value,
         CASE WHEN d IS NULL THEN 'none' ELSE 'asymp' END AS method,
         coalesce(greatest(0.0, least(1.0, raw)) < 0.05, false) AS drift_detected FROM p)
SELECT {columns} FROM res"""


SQL["ks_drift_test"] = _ks_verdict_sql(f"lt.latest - {DRIFT_DAYS - 1}", "*")
SQL["ks_drift_flag"] = _ks_verdict_sql("CAST(lt.latest - INTERVAL 11 MONTH AS DATE)",
                                       "series_id, n_ref, n_cur, ks_statistic, drift_detected")
SQL["ks_drift_statistic"] = _ks_sql(f"lt.latest - {DRIFT_DAYS - 1}")
SQL["ks_drift_statistic_monthly"] = _ks_sql("CAST(lt.latest - INTERVAL 11 MONTH AS DATE)")

SQL["adf_lag0"] = f"""WITH {prices_cte()},
pr AS (
  SELECT ticker, lag(close) OVER {W} AS x, close - lag(close) OVER {W} AS dy FROM prices),
g AS (
  SELECT ticker, count(*) AS n, {comoment("x", "dy")} AS sxy, {comoment("x", "x")} AS sxx,
         {comoment("dy", "dy")} AS syy
  FROM pr WHERE x IS NOT NULL GROUP BY ticker)
SELECT ticker, n, sxy / sxx AS gamma,
       (sxy / sxx) / sqrt(((syy - sxy * sxy / sxx) / CAST(n AS DOUBLE)) / (CAST(n AS DOUBLE) - 2)
                          / (sxx / CAST(n AS DOUBLE))) AS adf_stat
FROM g"""

SQL["streaming_monthly_bars"] = SQL["monthly_price_bars"]

SQL["streaming_drift_updates"] = SQL["ks_drift_test"]

# numpy's array_split sizes: the first n % 5 folds hold one row more
SQL["cv_folds"] = f"""WITH {e1_features()},
{sup_cte(1)},
f AS (
  SELECT ticker, month, row_number() OVER (PARTITION BY ticker ORDER BY month) - 1 AS i,
         count(*) OVER (PARTITION BY ticker) AS n FROM sup WHERE NOT is_test)
SELECT ticker, month, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
       ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM f"""


def _adf_test_sql() -> str:
    def poly(coef):
        return " + ".join(f"({c}) * t ** {k}" for k, c in enumerate(coef))

    series = ("list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs(z)) "
              "- ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())))))")
    return f"""WITH l AS ({SQL['adf_lag0']}),
z AS (
  SELECT *, adf_stat AS t, CASE WHEN adf_stat <= {stats.ADF_C_TAU_STAR} THEN {poly(stats.ADF_C_SMALLP).replace('t **', 'adf_stat **')}
    ELSE {poly(stats.ADF_C_LARGEP).replace('t **', 'adf_stat **')} END AS z FROM l),
p AS (
  SELECT *, CASE WHEN t > {stats.ADF_C_TAU_MAX} THEN 1.0 WHEN t < {stats.ADF_C_TAU_MIN} THEN 0.0
    WHEN z = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 0.5 + sign(z) * {series} * exp(-z * z / 2) / sqrt(2 * pi()))) END AS raw
  FROM z)
SELECT ticker, n, gamma, adf_stat, round(raw, 8) AS p_value, coalesce(raw < 0.05, false) AS stationary FROM p"""


SQL["adf_test"] = _adf_test_sql()

# co-moments of the level (a), the lagged change (b) and the change (y); both lags compete on the rows from t = 3
SQL["adf_short_lags"] = f"""WITH {prices_cte()},
d AS (
  SELECT ticker, month, row_number() OVER {W} AS t, lag(close) OVER {W} - avg(close) OVER (PARTITION BY ticker) AS a,
         close - lag(close) OVER {W} AS y FROM prices),
f AS (SELECT *, lag(y) OVER {W} AS b FROM d),
g AS (
  SELECT ticker, count(*) AS n, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, var_pop(y) * count(*) AS yy,
         covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS bb_y
  FROM f WHERE t >= 3 GROUP BY ticker),
z AS (
  SELECT ticker, count(*) AS n0, var_pop(a) * count(*) AS aa0, var_pop(y) * count(*) AS yy0,
         covar_pop(a, y) * count(*) AS ay0 FROM f WHERE t >= 2 GROUP BY ticker),
s AS (
  SELECT *, aa * bb - ab * ab AS det, yy - ay * ay / aa AS short,
         yy - (bb * ay * ay - 2 * ab * ay * bb_y + aa * bb_y * bb_y) / (aa * bb - ab * ab) AS long
  FROM g JOIN z USING (ticker)),
c AS (
  SELECT *, n * (ln(2 * pi()) + ln(short / n) + 1) + 4 AS ic0, n * (ln(2 * pi()) + ln(long / n) + 1) + 6 AS ic1 FROM s)
SELECT ticker, CASE WHEN ic1 < ic0 THEN n ELSE n0 END AS nobs, CAST(CASE WHEN ic1 < ic0 THEN 1 ELSE 0 END AS INTEGER) AS used_lag,
       round(least(ic0, ic1), 6) AS ic_best,
       round(CASE WHEN ic1 < ic0 THEN (bb * ay - ab * bb_y) / det / sqrt(long / (n - 3) * bb / det)
             ELSE ay0 / aa0 / sqrt((yy0 - ay0 * ay0 / aa0) / (n0 - 2) / aa0) END, 6) AS adf_stat
FROM c"""

SQL["provider_json_flatten"] = f"WITH {ind_cte()}\nSELECT series_id, month, value FROM ind"
SQL["traded_universe"] = f"WITH {prices_cte()}\nSELECT DISTINCT ticker FROM prices"
_wide_cols = [(f"{safe_name(t)}_{c.title()}", f"max(CASE WHEN ticker = {_q(t)} THEN {c} END)")
              for t in WIDE_TICKERS for c in ("close", "volume")]
SQL["wide_prices"] = (f"WITH {prices_cte()},\nw AS (SELECT month, " + ", ".join(f"{e} AS {n}" for n, e in _wide_cols)
                      + " FROM prices GROUP BY month)\nSELECT * FROM w WHERE "
                      + " AND ".join(f"{n} IS NOT NULL" for n, _ in _wide_cols))
SQL["feature_inputs"] = f"WITH {e1_features()}\nSELECT * EXCLUDE (close) FROM ft"
SQL["preview_bars"] = f"WITH {prices_cte()}\nSELECT * FROM prices ORDER BY ticker, month LIMIT 5"
SQL["long_histories"] = f"""WITH {prices_cte()}
SELECT * FROM prices WHERE ticker IN (SELECT ticker FROM prices GROUP BY ticker HAVING count(*) >= 83)"""
# every ticker of the longer horizon also has the shorter one, so the later run is horizon 3 where there is one
SQL["latest_runs"] = f"""WITH hg AS ({SQL['horizon_grid']})
SELECT ticker, model, horizon, rmse, mae, r2, n, CAST(CASE WHEN horizon = 3 THEN 1 ELSE 0 END AS INTEGER) AS run_seq
FROM hg QUALIFY row_number() OVER (PARTITION BY ticker, model ORDER BY horizon DESC) = 1"""
SQL["sorted_metrics"] = SQL["metrics_summary"]
SQL["feature_names"] = (f"WITH m AS ({SQL['metrics_summary']})\nSELECT ticker, model, "
                        + _q(", ".join(TEST_EXPERIMENTS[0].feature_list())) + " AS features FROM m")
SQL["ticker_ranges"] = f"""WITH {prices_cte()}
SELECT ticker, min(close) AS low, max(close) AS high, count(close) AS n FROM prices GROUP BY ticker"""
SQL["linear_residuals"] = f"""WITH {e1_features()},
{sup_cte(1)}
SELECT ticker, count(*) AS n_train, CAST(0 AS DOUBLE) AS mean_residual, CAST(0 AS DOUBLE) AS worst_correlation FROM sup WHERE NOT is_test GROUP BY ticker"""


# --- trees ------------------------------------------------------------------------

def root_cut_cte(target: str, src: str, l2: float, scale: float, n_bins: int = 16) -> str:
    """``binned`` rows and the ``best`` first cut of every ticker, from ``src``."""
    feats = TEST_EXPERIMENTS[0].feature_list()
    cuts = ", ".join(f"{k / n_bins}" for k in range(1, n_bins))
    part = lambda s, n: f"((CAST({s} AS DOUBLE) / {scale}) * (CAST({s} AS DOUBLE) / {scale}) / (CAST({n} AS DOUBLE) + {l2}))"
    return f"""long_rows AS (
  SELECT *, unnest(range({len(feats)})) AS feature, unnest([{', '.join(f'CAST({f} AS DOUBLE)' for f in feats)}]) AS x FROM {src}),
edges AS (
  SELECT ticker, feature, quantile_disc(x, [{cuts}]) FILTER (WHERE NOT is_test) AS e FROM long_rows GROUP BY ALL),
binned AS (
  SELECT l.*, len(list_filter(e, lambda q: q < x)) AS bin, CAST({target} AS BIGINT) AS t
  FROM long_rows l JOIN edges USING (ticker, feature)),
cells AS (
  SELECT ticker, feature, bin, count(*) AS cn, CAST(sum(t) AS BIGINT) AS cs FROM binned WHERE NOT is_test GROUP BY ALL),
sums AS (
  SELECT ticker, feature, bin, CAST(sum(cn) OVER u AS BIGINT) AS nl, CAST(sum(cs) OVER u AS BIGINT) AS sl,
    CAST(sum(cn) OVER a AS BIGINT) AS n, CAST(sum(cs) OVER a AS BIGINT) AS s
  FROM cells WINDOW a AS (PARTITION BY ticker, feature), u AS (PARTITION BY ticker, feature ORDER BY bin)),
gains AS (
  SELECT *, CASE WHEN nl >= 1 AND n - nl >= 1 THEN {part('sl', 'nl')} + {part('(s - sl)', '(n - nl)')} - {part('s', 'n')} END AS gain FROM sums),
best AS (
  SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY gain DESC NULLS LAST, feature, bin) = 1)"""


def leaf_sql(s: str, n: str, l2: float, scale: float) -> str:
    return f"CAST({s} AS DOUBLE) / {scale} / (CAST({n} AS DOUBLE) + {l2})"


def _tree_root_split_sql() -> str:
    feats = ", ".join(_q(f) for f in TEST_EXPERIMENTS[0].feature_list())
    value = lambda s, n: leaf_sql(s, n, 0.0, 10000.0)
    return f"""WITH {e1_features()},
{sup_cte(1)},
{root_cut_cte('round(y * 10000)', 'sup', 0.0, 10000.0)}
SELECT ticker, CASE WHEN gain > 0 THEN [{feats}][feature + 1] END AS feature, CASE WHEN gain > 0 THEN bin END AS bin, n,
  CASE WHEN gain > 0 THEN gain ELSE 0.0 END AS gain, {value('s', 'n')} AS value,
  CASE WHEN gain > 0 THEN {value('sl', 'nl')} END AS left_value, CASE WHEN gain > 0 THEN {value('(s - sl)', '(n - nl)')} END AS right_value
FROM best"""


SQL["tree_root_split"] = _tree_root_split_sql()


def _boosted_first_round_sql() -> str:
    unit = float(1 << 24)
    value = lambda s, n: leaf_sql(s, n, 1.0, unit)
    return f"""WITH {e1_features()},
{sup_cte(1)},
st AS ({_scaler_select()}),
scaled AS (SELECT s.*, (s.y - st.y_mean) / st.y_std AS y_scaled, st.y_mean, st.y_std FROM sup s JOIN st ON s.ticker = st.ticker),
{root_cut_cte(f'round(y_scaled * {unit})', 'scaled', 1.0, unit)}
SELECT b.ticker, b.month, b.y, (0.0 + CAST(0.1 AS DOUBLE) * CASE WHEN c.gain > 0 THEN
    CASE WHEN b.bin > c.bin THEN {value('(c.s - c.sl)', '(c.n - c.nl)')} ELSE {value('c.sl', 'c.nl')} END
    ELSE {value('c.s', 'c.n')} END) * b.y_std + b.y_mean AS predicted
FROM binned b JOIN best c ON c.ticker = b.ticker AND c.feature = b.feature"""


SQL["boosted_first_round"] = _boosted_first_round_sql()


def _experiment_residuals_sql() -> str:
    parts = []
    for exp in TEST_EXPERIMENTS:
        for h in (1, 3):
            parts.append(f"SELECT {_q(exp.name)} AS experiment, * FROM (WITH {e1_features(list(exp.indicators), exp.tickers)},\n{sup_cte(h)}\n"
                         f"SELECT ticker, CAST({h} AS INTEGER) AS horizon, count(*) AS n_train, CAST(0 AS DOUBLE) AS mean_residual, "
                         "CAST(0 AS DOUBLE) AS worst_correlation FROM sup WHERE NOT is_test GROUP BY ticker)")
    return "\nUNION ALL\n".join(parts)


SQL["experiment_linear_residuals"] = _experiment_residuals_sql()

SQL["asof_trades"] = """WITH t AS (
  SELECT p_brand AS ticker, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS seq, l_extendedprice AS price, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (
  SELECT o_orderdate AS ots, max(o_orderkey) AS last_order, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY ots)
SELECT t.*, o.last_order, o.last_price FROM t ASOF LEFT JOIN o ON t.ts >= o.ots"""


def _versions_sql() -> str:
    parts = []
    for k, size in ((1, 0.4), (2, 0.2)):
        parts.append(sup_cte(1, name=f"s{k}").replace("CAST(0.2 AS DOUBLE)", f"CAST({size} AS DOUBLE)") + ",\n" + ols_cte(f"s{k}", name=f"m{k}"))
    return f"""WITH {e1_features()},
{", ".join(parts)},
starts AS (SELECT ticker, min(month) AS f2 FROM s2 WHERE is_test GROUP BY ticker),
firsts AS (SELECT ticker, min(month) AS f1 FROM s1 WHERE is_test GROUP BY ticker)
SELECT ticker, month, 'OLS' AS model, CAST(1 AS INTEGER) AS version, y, predicted FROM m1 JOIN firsts USING (ticker) JOIN starts USING (ticker)
WHERE month >= f1 AND month < f2
UNION ALL
SELECT ticker, month, 'OLS', 2, y, predicted FROM m2 JOIN starts USING (ticker) WHERE month >= f2"""


SQL["score_model_versions"] = _versions_sql()
