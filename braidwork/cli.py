"""Command line: python -m braidwork.cli --csv people.csv --resume-dir resumes --output out.json"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from braidwork.config import EngineConfig, ProjectionConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Link and fuse records of people.")
    p.add_argument("--csv", "--recruiter-csv", dest="csv")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--resume", action="append", default=[])
    one.add_argument("--resume-dir")
    p.add_argument("--projection", "--config", dest="projection")
    p.add_argument("--engine-config")
    p.add_argument("--output")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--pretty", action="store_true", default=True)
    how.add_argument("--compact", dest="pretty", action="store_false")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)  # messages name files and counts, never people
    for path in filter(None, (a.csv, a.resume_dir, *a.resume, a.projection, a.engine_config)):
        if not os.path.exists(path):
            print(f"error: no such path: {path}", file=sys.stderr)
            return 1
    if not (a.csv or a.resume_dir or a.resume):
        print("error: give --csv, --resume or --resume-dir", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from braidwork.plans.engine import Engine
    from braidwork.sinks import describe, write_document

    spark = SparkSession.builder.appName("braidwork").getOrCreate()
    cfg = EngineConfig.from_file(a.engine_config) if a.engine_config else EngineConfig()
    shape = ProjectionConfig.from_file(a.projection) if a.projection else None
    result = Engine(spark, cfg, shape).run_files(a.csv, a.resume_dir, tuple(a.resume))
    if a.output:
        write_document(result, a.output, a.pretty)
    print(describe(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
