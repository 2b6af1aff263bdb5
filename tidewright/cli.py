"""tidewright demo|inspect|validate|run|report: experiments from the command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time
import traceback

from pyspark.sql import SparkSession

from tidewright.operators.disclosure import DisclosureError
from tidewright.plans import arms as plans
from tidewright.plans import inspect
from tidewright.plans.config import ConfigError, load_config
from tidewright.plans.report import build_report, redraw
from tidewright.sources import demo
from tidewright.sources.loaders import load_all
from tidewright.sources.publish import MANIFEST, Writer, manifest, write_manifest
from tidewright.sources.schema import SchemaError

logger = logging.getLogger("tidewright")


class Collector(logging.Handler):
    """Keeps warnings for the manifest."""

    def __init__(self):
        super().__init__(logging.WARNING)
        self.lines: list[str] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(record.getMessage())


def session() -> SparkSession:
    return (
        SparkSession.builder.appName("tidewright").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def validate(path: str, spark: SparkSession | None = None) -> int:
    config = load_config(path)
    bundle = load_all(spark or session(), config)
    people = bundle.population()
    print(f"{config.model.name}: {people['n_persons']} people")
    for r in sorted(bundle.windows().collect()):
        print(f"window {r['age_start']} to {r['age_stop']} days: {r['n_persons']} people, {r['n_seeds']} seeds")
    return 0


def run(path: str, only: list[str] | None = None, force: bool = False, report: bool = True, spark: SparkSession | None = None) -> int:
    """0 if all arms ran, 1 if one failed, 2 if nothing could be run."""
    config = load_config(path)
    target = config.output.dir
    if os.path.exists(os.path.join(target, MANIFEST)) and not force:
        print(f"{target} has results; use --force to replace them", file=sys.stderr)
        return 2
    collector = Collector()
    logging.getLogger("tidewright").addHandler(collector)
    try:
        bundle = load_all(spark or session(), config)
        study = plans.Study(bundle, config)
        states = []
        for name, arm in plans.ARMS.items():
            if getattr(config.arms, name) is None or only and name not in only:
                continue
            out = Writer(name, target, config.model.name, config.output.min_cell, config.output.individual_level, config.output.figures)
            state, began = {"arm": name, "status": "ok"}, time.time()
            try:
                arm(study, out)
            except Exception as e:  # one arm must not take the others along; the manifest tells
                logger.error("%s failed: %s", name, e)
                logger.debug("%s", traceback.format_exc())
                state |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:2000]}
            states.append(state | {"outputs": out.written, "withheld": out.withheld, "duration_s": round(time.time() - began, 2)})
        windows = [r.asDict() for r in sorted(bundle.windows().collect())]
        write_manifest(target, manifest(bundle.observed.sparkSession, config, states, windows, bundle.population(), collector.lines))
        study.close()
        if config.output.figures:
            redraw(target)
        if report:
            build_report(target)
        return int(any(s["status"] != "ok" for s in states))
    finally:
        logging.getLogger("tidewright").removeHandler(collector)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    v = commands.add_parser("validate", help="check a configuration and its data")
    v.add_argument("config")
    r = commands.add_parser("run", help="run the arms of a configuration")
    r.add_argument("config")
    r.add_argument("--arm", action="append", choices=sorted(plans.ARMS))
    r.add_argument("--force", action="store_true")
    r.add_argument("--no-report", action="store_true")
    p = commands.add_parser("report", help="write the report of a finished run")
    p.add_argument("directory")
    p.add_argument("--redraw", action="store_true", help="draw the figures again first")
    d = commands.add_parser("demo", help="write a synthetic experiment")
    d.add_argument("directory")
    d.add_argument("--people", type=int, default=1000)
    d.add_argument("--seeds", type=int, default=10)
    i = commands.add_parser("inspect", help="show what the tables of a configuration hold")
    i.add_argument("config")
    args = parser.parse_args(argv)
    try:
        if args.command == "validate":
            return validate(args.config)
        if args.command == "run":
            return run(args.config, args.arm, args.force, not args.no_report)
        if args.command == "demo":
            print(demo.write(session(), args.directory, people=args.people, seeds=args.seeds))
            return 0
        if args.command == "inspect":
            bundle = load_all(session(), load_config(args.config))
            for name, about in inspect.overview(bundle).items():
                print(f"{name}: {about['rows']} rows, {about['people']} people, {about['columns']}")
            inspect.sample_sequences(bundle.observed).show(50, truncate=False)
            return 0
        if args.redraw:
            redraw(args.directory)
        print(build_report(args.directory))
        return 0
    except (ConfigError, SchemaError, DisclosureError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
