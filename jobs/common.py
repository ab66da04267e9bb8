"""What the jobs share: their config files and their command line."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("lodestone.jobs")


def settings(kind: type, path: str | Path):  # noqa: ANN201
    """A dataclass of settings from the [settings] of a TOML file; an unknown name is an error."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("settings", {})
    unknown = set(found) - {x.name for x in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**found)


def command_line(name: str, doc: str, paths: tuple[str, ...], kind: type, run: Callable[..., object], argv: list[str] | None = None) -> None:
    """Runs a job with paths and a config file from the command line, in a session of its own."""
    from lodestone.shipping import ship

    parser = argparse.ArgumentParser(prog=name, description=doc)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.toml")))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        ship(spark)
        run(spark, *[getattr(args, p) for p in paths], settings(kind, args.config))
    finally:
        spark.stop()
