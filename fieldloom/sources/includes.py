"""Included documents: files under given roots, found by the path a field names."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession, functions as F


def distinct_roots(roots: list[str]) -> list[str]:
    """Each root once, without regard to case."""
    return list({posixpath.normpath(r.replace("\\", "/")).lower(): posixpath.normpath(r.replace("\\", "/")) for r in reversed(roots)}.values())[::-1]


def candidates(requested: str, roots: list[str]) -> list[str]:
    """Paths to try, in order. A path with a root of its own counts if it lies under one of ``roots``; else, and for shares and
    drives, ever shorter ends of it are looked for under each root. What would leave a root is no candidate."""
    path = requested.strip().replace("\\", "/")
    drive = re.match(r"[A-Za-z]:/", path)
    rooted = bool(drive) or path.startswith("/")
    parts = [p for p in (path[3:] if drive else path).split("/") if p]
    out: dict[str, str] = {}

    def add(candidate: str, root: str) -> None:
        full = posixpath.normpath(candidate)
        if full.lower().startswith(root.rstrip("/").lower() + "/"):
            out.setdefault(full.lower(), full)

    held = distinct_roots(roots)
    if path.startswith("/") and not path.startswith("//"):
        for root in held:
            add(path, root)
    for root in held:
        for i in range(len(parts)) if rooted else [0, *range(len(parts))]:
            add(posixpath.join(root, *parts[i:]), root)
    return list(out.values())


def load(spark: SparkSession, requests: list[str], roots: list[str]) -> DataFrame:
    """(request, path, content, format) of the first candidate there is for each request; requests without one have no row."""
    rows = [(r, p, i) for r in dict.fromkeys(requests) for i, p in enumerate(candidates(r, roots))]
    wanted = spark.createDataFrame(rows, "request string, want string, rank int")
    files = None
    for root in distinct_roots(roots):
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        files = part if files is None else files.union(part)
    bare = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    found = files.select("path", "content", F.lower(bare).alias("key")).join(F.broadcast(wanted), F.col("key") == F.lower("want"))
    best = found.groupBy("request").agg(F.min_by(F.struct("path", "content"), "rank").alias("f")).select("request", "f.path", "f.content")
    return best.withColumn("format", F.when(F.lower("path").rlike(r"\.html?$"), "html").otherwise("docx"))
