"""Command line: ``python -m loomspark features ROOT… OUT``, ``baseline FEATURES OUT`` and ``golden RECORDING MODEL OUT``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import SparkSession

from loomspark.operators import learning as ln
from loomspark.operators.windows import Grid, Zones
from loomspark.plans import evaluate, files, golden, sensors
from loomspark.sources import sinks

EVENTS = {"TAKEOFF": "t_takeoff", "LANDING": "t_landing"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomspark")
    commands = top.add_subparsers(dest="command", required=True)
    f = commands.add_parser("features", help="recordings to feature tables")
    f.add_argument("roots", nargs="+")
    f.add_argument("out")
    for flag, kind, default in (("accel_hz", float, 20.0), ("baro_hz", float, 1.0), ("hold", float, 5.0), ("coverage", float, 0.8), ("keep_quiet", float, 1.0), ("seed", int, 42)):
        f.add_argument(f"--{flag}", type=kind, default=default)
    for name, win, hop in (("base", 10.0, 2.0), ("to", 20.0, 10.0), ("ld", 24.0, 12.0)):
        f.add_argument(f"--{name}", type=float, nargs=2, default=(win, hop), metavar=("WIN", "HOP"))
    f.add_argument("--rule", choices=("anchor", "overlap"), default="anchor")
    f.add_argument("--where", choices=("center", "right"), default="right")
    f.add_argument("--no_fill", action="store_true")
    f.add_argument("--drop_ambiguous", action="store_true")
    f.add_argument("--scaled", action="store_true")
    f.add_argument("--resampled", action="store_true")
    f.add_argument("--no_csv", action="store_true")
    b = commands.add_parser("baseline", help="feature table to fitted baselines and their reports")
    b.add_argument("features", help="a folder that features has written, or CSV files")
    b.add_argument("out")
    b.add_argument("--model", choices=("forest", "boosted"), default="forest")
    b.add_argument("--events", nargs="+", choices=sorted(EVENTS), default=sorted(EVENTS))
    b.add_argument("--seeds", type=int, nargs="+", default=[42])
    b.add_argument("--draws", type=int, default=0, help="settings to try; 0: none")
    b.add_argument("--space", type=json.loads, default={"trees": [50, 100, 200], "depth": [4, 6, 8]}, help="JSON object of lists")
    b.add_argument("--suggest", action="store_true", help="settings by Parzen estimators of those before; the space may hold intervals as {\"low\": 1, \"high\": 2, \"log\": true}")
    b.add_argument("--weights", type=json.loads, default=[], help="JSON list of objects with w_mid and w_far")
    b.add_argument("--params", type=json.loads, default={}, help="JSON object of model settings")
    for r in fields(evaluate.Rules):
        if r.name != "seed":
            b.add_argument(f"--{r.name}", type=type(r.default), default=r.default)
    g = commands.add_parser("golden", help="a recording to reference arrays of its first windows")
    g.add_argument("recording")
    g.add_argument("model", help="a folder with features.json and scaler.npz")
    g.add_argument("out", help="the array file to write")
    g.add_argument("--windows", type=int, default=50)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "features":
        grids = tuple(Grid(n, i, *getattr(args, n)) for i, n in enumerate(("base", "to", "ld")))
        cfg = sensors.Settings(args.accel_hz, args.baro_hz, args.hold, not args.no_fill, args.coverage, grids, Zones(drop=args.drop_ambiguous), args.rule, args.where, keep_quiet=args.keep_quiet, seed=args.seed)
        report = files.extract(spark, args.roots, args.out, cfg, args.scaled, args.resampled, not args.no_csv)
    elif args.command == "golden":
        report = golden.write(spark, args.recording, args.model, args.out, golden.Settings(windows=args.windows))
    else:
        rules = evaluate.Rules(**{r.name: getattr(args, r.name) for r in fields(evaluate.Rules) if r.name != "seed"})
        table = sinks.load_features(spark, args.features) if args.features.endswith(".csv") else sinks.read_features(spark, args.features)
        if "rec" not in table.columns:
            table = table.withColumn("rec", table["file_id"] if "file_id" in table.columns else table["file"])
        found = [c for c, kind in table.dtypes if c in set(sensors.signal_features(table)) and kind == "double"]
        model = ln.forest if args.model == "forest" else ln.boosted
        space = {k: (v["low"], v["high"], "log" if v.get("log") else "") if isinstance(v, dict) else v for k, v in args.space.items()} if args.draws else None
        report = evaluate.baselines(table, found, {e: EVENTS[e] for e in args.events}, args.seeds, args.out, rules, model, space, args.draws, args.weights, args.suggest, **args.params)
    print(json.dumps(sinks.strict(report), sort_keys=True))
    return report


if __name__ == "__main__":
    main()
