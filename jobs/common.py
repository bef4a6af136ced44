"""What both jobs share: arguments, settings and the session of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def settings(path: str | Path, given: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A job's settings from its JSON file, with some of them replaced; unknown names are refused."""
    out = json.loads(Path(path).read_text())
    unknown = set(given or ()) - set(out)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return out | dict(given or {})


def main(run: Callable[..., Any], name: str, paths: Sequence[str], default: Path, argv: Sequence[str] | None = None) -> None:
    """Run a job from the command line: its paths, and a settings file."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for path in paths:
        parser.add_argument(path)
    parser.add_argument("--config", default=str(default), help="JSON file with the job's settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *[getattr(args, p) for p in paths], settings(args.config))
    finally:
        spark.stop()
