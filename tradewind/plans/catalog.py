"""Registration of queries: a Spark plan and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.plans.fixtures import duck, logical

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """t.usage_event and so on: the logical tables; t.raw("events"): a raw one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return logical(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def register(plan: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(spark, sf_dir))

        run.plan = plan
        if plan.__name__ in QUERIES:
            raise ValueError(f"the query {plan.__name__} is registered already")
        QUERIES[plan.__name__] = run
        if oracle:
            ORACLES[plan.__name__] = duck(oracle)
        return run

    return register
