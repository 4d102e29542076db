"""Databases behind DATABASE fields: connections by label, queries with named parameters, ranges of records, results."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldloom.functions.values import Value, as_text, of_type, text
from fieldloom.plans.fields import DatabaseRequest

#: Runs a query with named parameters and returns its rows.
Connection = Callable[[str, dict], DataFrame]


def spark_connection(spark: SparkSession) -> Connection:
    """Tables and views of the session. A parameter is ``:name`` in the query."""
    return lambda query, parameters: spark.sql(query, args=parameters)


def jdbc_connection(spark: SparkSession, url: str, **options: str) -> Connection:
    """A database by JDBC; its rows come as Spark partitions, parameters as quoted literals in the query."""

    def run(query: str, parameters: dict) -> DataFrame:
        for name, value in sorted(parameters.items(), key=lambda p: -len(p[0])):
            quoted = str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
            query = query.replace(f":{name}", quoted)
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()

    return run


def connection(connections: Mapping[str, Connection], label: str | None) -> Connection:
    """By the label as it is, as a file's name, as that without its ending, else the one named ``*``."""
    held = {k.lower(): v for k, v in connections.items()}
    names = [] if not label else [label, os.path.basename(label.replace("\\", "/"))]
    names += [os.path.splitext(names[-1])[0]] if names else []
    for name in [*names, "*"]:
        if name.lower() in held:
            return held[name.lower()]
    raise KeyError(f"no connection for the data source {label!r}")


def select_rows(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Records ``first`` to ``last``, from 1, of a query in its own order; none if the last is before the first."""
    start = max(1, first or 1)
    if last is not None and last < start:
        return df.limit(0)
    df = df.offset(start - 1) if start > 1 else df
    return df if last is None else df.limit(last - start + 1)


def result_text(df: DataFrame, headings: bool = False) -> DataFrame:
    """One row: the records in the query's order as lines of tab-separated values; empty without a record, headings or not."""
    cells = [F.coalesce(as_text(of_type(F.col(f"`{c}`"), t)), F.lit("")) for c, t in df.dtypes]
    lines = df.select(F.monotonically_increasing_id().alias("o"), F.concat_ws("\t", *cells).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda r: r["l"]), "\n")
    head = "\t".join(df.columns) + "\n" if headings else ""
    return lines.agg(F.when(F.count("*") > 0, F.concat(F.lit(head), body)).otherwise("").alias("body"))


def single_value(df: DataFrame, headings: bool = False) -> Value | None:
    """The value of a result of one column, typed; the column is null unless there is just one record. None of other results
    and of those with headings. The query runs when the plan is built, and its one value is a constant of the plan."""
    if headings or len(df.columns) != 1:
        return None
    name, kind = df.columns[0], df.dtypes[0][1]
    one = df.limit(2).agg(F.when(F.count("*") == 1, F.first(f"`{name}`")).alias("v"))
    return of_type(F.lit(one.first()[0]).cast(kind), kind)


def provider(connections: Mapping[str, Connection], parameter: Callable[[Column], object] | None = None) -> Callable[[DatabaseRequest], Value]:
    """What a context's ``database`` needs. Parameters have to be constants; their values are taken when the plan is built."""

    def run(request: DatabaseRequest) -> Value:
        open_ = connection(connections, request.source)
        held = {k: parameter(v.column) if parameter else v.column for k, v in request.parameters.items()}
        df = select_rows(open_(request.query, held), request.first, request.last)
        value = single_value(df, request.headings)
        body = text(result_text(df, request.headings).scalar())
        if value is None:
            return body
        return Value(value.kind, value.column) if value.kind != "text" else text(F.coalesce(value.column, body.column))

    return run
