"""Lazy table graph of one dataset: sources, stage tables and the steps between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import write_stage

Step = Callable[["Workspace"], DataFrame]
_STEPS: dict[str, tuple[Step, bool]] = {}
_OPEN: dict[tuple[str, str], "Workspace"] = {}


def step(name: str, stored: bool = False) -> Callable[[Step], Step]:
    """Register how a named table is derived; ``stored`` steps are stage boundaries."""
    def add(fn: Step) -> Step:
        _STEPS[name] = (fn, stored)
        return fn
    return add


class Workspace:
    """Tables of one dataset by name. Each is planned once; stage tables are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name in _STEPS:
                fn, stored = _STEPS[name]
                df = fn(self)
                self._tables[name] = write_stage(df, name) if stored else df
            else:
                self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]


def forget_workspaces() -> None:
    """Drop planned tables, so that the next query derives everything again."""
    _OPEN.clear()
