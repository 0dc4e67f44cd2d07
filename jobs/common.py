"""What the jobs share: their config, their log, and counts of the rows that pass by."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import os
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

C = TypeVar("C")


def load_config(kind: type[C], argv: list[str] | None, about: str) -> C:
    """A dataclass from the JSON file that ``--config`` names, with the options of the command line over it.

    An unknown field, a missing one and a value of another type are errors.
    """
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file with the fields below")
    fields = dataclasses.fields(kind)
    for f in fields:
        parser.add_argument(f"--{f.name.replace('_', '-')}", default=None)
    given = vars(parser.parse_args(argv))
    values = {}
    if path := given.pop("config"):
        with open(path) as file:
            values = json.load(file)
    if unknown := set(values) - {f.name for f in fields}:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    values |= {k: v for k, v in given.items() if v is not None}
    read: dict[str, Callable] = {"str": str, "int": int, "float": float, "str | None": lambda x: None if x is None else str(x)}
    missing = [f.name for f in fields if f.name not in values and f.default is dataclasses.MISSING]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return kind(**{f.name: read[f.type](values[f.name]) for f in fields if f.name in values})


def seen(observation: Observation) -> int:
    """The rows that an action has counted; none if Spark found the plan to be empty and left the count out of it."""
    try:
        return observation.get["rows"]
    except Py4JJavaError:  # an observation without a row cannot be read
        return 0


def command_line(name: str, job: Callable[[SparkSession, C], object], config: C) -> None:
    """Runs ``job`` in a session of its own; the only place where one is made and stopped."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, config)
    finally:
        spark.stop()
