"""Registration of queries, and access to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evalspark.session import ship

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Source:
    """Given tables of one scale factor."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, text: str) -> DataFrame:
        """Run a fixture text; ``{name}`` stands for a given table."""
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Query:
    run: Callable[[Source], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return self.run(Source(spark, folder.rstrip("/")))


REGISTRY: dict[str, Query] = {}


def query(oracle: str | None = None) -> Callable[[Callable[[Source], DataFrame]], Callable[[Source], DataFrame]]:
    def register(run: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        assert run.__name__ not in REGISTRY, run.__name__
        REGISTRY[run.__name__] = Query(run, oracle)
        return run

    return register


def plain(text: str) -> str:
    """A fixture text as SQL on the registered views."""
    return text.format(**{t: t for t in TABLES})


def with_view(text: str, rest: str) -> str:
    """``fx`` bound to a fixture, followed by more WITH entries and the final SELECT."""
    return f"WITH fx AS ({plain(text)}) {rest}"
