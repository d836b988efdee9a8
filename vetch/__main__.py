"""python -m vetch run|refresh|serve."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import run
from .plans.service import Service, serve
from .plans.store import ParquetStore


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vetch")
    p.add_argument("--deliverables", default="deliverables")
    sub = p.add_subparsers(dest="what", required=True)
    for what in ("run", "refresh"):
        q = sub.add_parser(what)
        q.add_argument("--name", required=True)
        q.add_argument("--kind", default="document")
        q.add_argument("--input", required=True)
        q.add_argument("--generate", action="store_true")
    sub.choices["run"].add_argument("--profile", default="general", choices=run.PROFILES)
    sub.choices["run"].add_argument("--draft", action="append", default=[])
    sub.choices["refresh"].add_argument("--from-run", required=True)
    sub.add_parser("serve")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("vetch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = ParquetStore(spark, f"{a.deliverables}/store")
    if a.what == "serve":
        serve(Service(spark, store, a.deliverables))
        return 0
    try:
        if a.what == "run":
            out = run.start(spark, store, a.deliverables, a.name, a.input, a.kind, a.profile, a.draft, a.generate)
        else:
            out = run.refresh(spark, store, a.deliverables, a.from_run, a.name, a.input, a.kind, a.generate)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print(f"{out['run_id']} {out['state']}: {out['path']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
