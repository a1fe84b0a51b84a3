"""The engine: tables by name, statements in, DataFrames or plan text out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.statistics import Statistics
from tessera.plans.planner import Node, Planner
from tessera.plans.sql import parse
from tessera.sources.catalog import catalog_tables, tables
from tessera.sources.text import write_out


class Engine:
    """mode "ansi" follows standard SQL; "compat" the older dialect (see the README)."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame], statistics: Statistics | None = None, mode: str = "ansi"):
        self.spark, self.frames, self.statistics, self.mode = spark, frames, statistics, mode

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, **options) -> Engine:
        """An engine over the parquet tables of a folder."""
        return cls(spark, tables(spark, sf_dir), **options)

    @classmethod
    def from_catalog(cls, spark: SparkSession, text: str, folder: str, **options) -> Engine:
        """An engine over the text tables that a catalog names, in a folder."""
        return cls(spark, catalog_tables(spark, text, folder), **options)

    def _planner(self, mode: str | None) -> Planner:
        return Planner(self.frames, self.statistics, mode or self.mode)

    def plan(self, text: str, mode: str | None = None) -> Node:
        return self._planner(mode).plan(parse(text, mode or self.mode))

    def sql(self, text: str, mode: str | None = None) -> DataFrame:
        """The rows of a statement."""
        return self._planner(mode).run(parse(text, mode or self.mode))

    def write(self, text: str, path: str, mode: str | None = None) -> None:
        """Write the rows of a statement to path as text lines (see write_out())."""
        write_out(self.sql(text, mode), path)

    def explain_tree(self, text: str, mode: str | None = None, path: str | None = None) -> str:
        """The plan of a statement as text; with path, that of writing its rows there."""
        node = self.plan(text, mode)
        node = node if path is None else Node("WRITE", [node], node.schema, {"path": path})
        return "\n".join(self._planner(mode).explain(node))
