"""Robots policies: parsing, and the prefix test as a column expression."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGENT = "quillbot"
_INTEGER = re.compile(r"[+-]?[0-9]+")


def _fields(record: str) -> Iterable[tuple[str, str]]:
    for line in re.split(r"\r\n|\r|\n", record):
        name, colon, value = line.partition("#")[0].partition(":")
        if colon:
            if not name.strip():
                raise ValueError("a line of a robots text has no field")
            yield name.strip().lower(), value.strip()


def parse_robots(text: str, agent: str = AGENT) -> tuple[int, list[str]]:
    """(crawl delay in seconds, disallowed path prefixes) for an agent.

    Records are separated by empty lines. Those of any agent (*) count until one names the agent itself: that one is
    the last that is read, and what came before stays. Names of agents are compared as they are. Only disallow and
    crawl-delay are known; of several delays the last holds. A line without a field, and a delay that isn't a whole
    number, raise ValueError.
    """
    delay, paths = 0, []
    for record in re.split(r"(?:\r\n){2,}|\n{2,}", text):
        agents = [v for k, v in _fields(record) if k == "user-agent"]
        if agent not in agents and "*" not in agents:
            continue
        for name, value in _fields(record):
            if name == "disallow" and value and value not in paths:
                paths.append(value)
            elif name == "crawl-delay":
                if not _INTEGER.fullmatch(value):
                    raise ValueError(f"crawl-delay {value!r} isn't a whole number")
                delay = int(value)
        if agent in agents:
            break
    return delay, sorted(paths)


def policies(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """host, delay, disallow (array) and valid for each row of robots (host, text).

    A null text, as of a host without the file, is an empty policy. A text that can't be parsed has valid false: a
    crawler passes such a host's pages over.
    """

    def run(batches):
        for b in batches:
            rows = []
            for host, text in zip(b["host"], b["text"]):
                try:
                    delay, paths = parse_robots(text or "", agent)
                    rows.append((host, delay, paths, True))
                except ValueError:
                    rows.append((host, 0, [], False))
            yield pd.DataFrame(rows, columns=["host", "delay", "disallow", "valid"])

    return robots.select("host", "text").mapInPandas(run, "host string, delay int, disallow array<string>, valid boolean")


def disallowed(path: Column | str, prefixes: Column | str) -> Column:
    """Whether a path starts with any of the prefixes."""
    path, prefixes = (F.col(x) if isinstance(x, str) else x for x in (path, prefixes))
    return F.exists(prefixes, lambda p: F.startswith(path, p))
