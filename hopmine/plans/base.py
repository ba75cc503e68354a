"""A registry of queries: each reads its tables from a folder and may have SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import star_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GRAPHS = {True: star_graph.SQL, "places": star_graph.PLACES_SQL, "whole": star_graph.WHOLE_SQL}


def query(sql: str | None = None, graph: bool | str = False) -> Callable[[Query], Query]:
    """Registers a query; graph puts the table expressions of the star graph, of its `places`, or of the `whole` with trades, before the SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {GRAPHS[graph]} {sql}" if graph else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
