"""All registered queries of the graph operators, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.bindings import Facts, facts, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Facts], DataFrame]], Callable[[Facts], DataFrame]]:
    """Registers a function of facts as a query, with SQL over tables and bindings that gives the same rows."""

    def register(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: f(facts(spark, sf_dir))
        if sql:
            ORACLE[name] = with_bindings(sql)
        return f

    return register


from loomgraph.plans import atlas, benchmark, claims, files, graph, labels, lookups, maintenance, text, upkeep  # noqa: E402, F401
