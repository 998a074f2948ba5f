"""python -m evalloom.cli JOB --name value ...: a job of evalloom.jobs over paths; its tables are written below --out and counted."""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from evalloom import jobs
from evalloom.operators.relations import CheckFailed
from evalloom.session import session

JOBS = {f.__name__: f for f in (jobs.build, jobs.seeded, jobs.bundled, jobs.validate, jobs.evaluate, jobs.report, jobs.compare, jobs.screened, jobs.replayed, jobs.checked, jobs.costs)}
KINDS = {"list[str]": lambda x: x.split(","), "dict": json.loads, "int": int, "float": float}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evalloom", description=__doc__)
    top.add_argument("--master", help="a Spark master; by default the submitting environment's")
    each = top.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        sub = each.add_parser(name, help=job.__doc__)
        for p in list(inspect.signature(job).parameters.values())[1:]:
            required = p.default is inspect.Parameter.empty
            sub.add_argument(f"--{p.name.rstrip('_').replace('_', '-')}", dest=p.name, required=required, default=None if required else p.default, type=KINDS.get(p.annotation, str))
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    job, spark = JOBS[args.pop("job")], session(args.pop("master"))
    try:
        print(json.dumps({name: df.count() for name, df in job(spark, **args).items()}, sort_keys=True))
    except CheckFailed as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
