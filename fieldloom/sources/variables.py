"""Document variables from files: JSON objects and INI lines, and overrides given by hand."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession


def parse_ini(text: str) -> dict[str, str]:
    """``name=value`` lines; the first ``=`` separates, ``#`` and ``;`` start comments."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#;" and "=" in line:
            name, _, value = line.partition("=")
            out[name.strip()] = value.strip()
    return out


def parse_json(text: str) -> dict[str, str]:
    """The members of an object; what is no text is shown as JSON, null as nothing."""
    return {k: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False) for k, v in json.loads(text).items()}


def load(spark: SparkSession, path: str) -> dict[str, str]:
    """One small file, read by Spark so that any file system will do."""
    body = spark.read.text(path, wholetext=True).first()
    body = body[0] if body else ""
    return parse_json(body) if path.lower().endswith(".json") else parse_ini(body)


def overrides(pairs: Iterable[str]) -> dict[str, str]:
    return dict(p.split("=", 1) for p in pairs if "=" in p)


def merged(file: Mapping[str, str], given: Mapping[str, str]) -> dict[str, str]:
    """Given variables beat those of a file, without regard to case."""
    taken = {k.upper() for k in given}
    return {k: v for k, v in file.items() if k.upper() not in taken} | dict(given)
