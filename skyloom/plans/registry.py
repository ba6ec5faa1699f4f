"""Registry of runnable queries: a name, a plan over the given tables, and where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from skyloom.plans import corpus


class Tables:
    """The given tables of one folder, and the measurement tables derived from them (all lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def track(self) -> DataFrame:
        return corpus.track(self.events)

    @cached_property
    def frames(self) -> DataFrame:
        return corpus.frames(self.lineitem)

    @cached_property
    def curves(self) -> DataFrame:
        return corpus.curves(self.lineitem)

    @cached_property
    def axes(self) -> DataFrame:
        return corpus.axes(self.embeddings)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return add
