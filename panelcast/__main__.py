"""Command line: run named experiments or drift checks on landed files.

  python -m panelcast experiments --prices DIR --indicators DIR --out DIR [--json DIR]
                                  [--names a,b] [--model linear|ols1] [--start D --end D]
  python -m panelcast drift --indicators DIR --out DIR [--reference-end 2024-12-31]
                            [--window-months 12] [--threshold 0.05]

Results are written with the sinks (parquet, metrics also as one CSV).
"""

from __future__ import annotations

import argparse
import sys


def _landed(spark, args):
    from panelcast.sources import files
    prices = files.keep_first(files.read_price_csvs(spark, args.prices), ["ticker", "month"])
    ind = files.read_indicator_csvs(spark, args.indicators)
    if getattr(args, "json", None):
        ind = ind.unionByName(files.read_observations_json(spark, args.json))
    ind = files.keep_first(ind, ["series_id", "month"])
    rejects = files.rejected_rows(spark, args.prices, "prices").unionByName(files.rejected_rows(spark, args.indicators))
    if getattr(args, "json", None):
        rejects = rejects.unionByName(files.rejected_observations(spark, args.json))
    for r in rejects.orderBy("file", "reason").collect():  # a row a file with such lines
        print(f"{r['n_rejected']} rows left out ({r['reason']}): {r['file']}", file=sys.stderr)
    if getattr(args, "start", None) or getattr(args, "end", None):
        from panelcast.operators.clean import range_slice
        prices = range_slice(prices, "month", args.start, args.end)
        ind = range_slice(ind, "month", args.start, args.end)
    return prices, ind


def run_experiments(spark, args) -> None:
    from panelcast.operators.align import missing_series
    from panelcast.plans.experiments import REFERENCE_EXPERIMENTS, run_experiments as run
    from panelcast.session import cut_lineage
    from panelcast.sources import sinks
    prices, ind = _landed(spark, args)
    wanted = set(args.names.split(",")) if args.names else None
    exps = [e for e in REFERENCE_EXPERIMENTS if wanted is None or e.name in wanted]
    requested = sorted({s for e in exps for s in e.indicators})
    missing = [r.series_id for r in missing_series(ind, requested).collect()]
    if missing:
        print(f"indicators without data, skipped: {missing}", file=sys.stderr)
    bt, m = run(prices, ind, exps, model=args.model)
    m = cut_lineage(m)  # computed once, written twice
    sinks.save_backtest(bt, args.out)
    sinks.save_metrics(m, args.out)
    sinks.save_metrics(m, args.out + "/csv", csv_export=True)


def run_drift(spark, args) -> None:
    from panelcast.operators.drift import ks_drift
    from panelcast.sources import files, sinks
    ind = files.keep_first(files.read_indicator_csvs(spark, args.indicators), ["series_id", "month"])
    res = ks_drift(ind, "series_id", "month", "value", args.reference_end,
                   window_months=args.window_months, threshold=args.threshold)
    sinks.write_table(res, args.out.rstrip("/") + "/drift")


def main(argv: list[str] | None = None) -> None:
    from panelcast.session import get_session
    ap = argparse.ArgumentParser(prog="panelcast")
    sub = ap.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("experiments")
    e.add_argument("--prices", required=True)
    e.add_argument("--indicators", required=True)
    e.add_argument("--json")
    e.add_argument("--out", required=True)
    e.add_argument("--names")
    e.add_argument("--model", default="linear", choices=["linear", "ols1"])
    e.add_argument("--start")
    e.add_argument("--end")
    d = sub.add_parser("drift")
    d.add_argument("--indicators", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--reference-end", default="2024-12-31")
    d.add_argument("--window-months", type=int, default=12)
    d.add_argument("--threshold", type=float, default=0.05)
    args = ap.parse_args(argv)
    spark = get_session()
    {"experiments": run_experiments, "drift": run_drift}[args.cmd](spark, args)


if __name__ == "__main__":
    main()
