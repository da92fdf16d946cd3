"""Declared sources: a logical name, and where it lives in each environment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from velomart.sources.scans import scan_parquet


@dataclass(frozen=True)
class Source:
    """Either a catalog table or a Parquet path (wildcards allowed)."""

    table: str | None = None
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.table:
            return spark.read.table(self.table)
        return scan_parquet(spark, self.path, self.options)


@dataclass
class SourceRegistry:
    """``registry.read(spark, "cycle_hire")`` reads from the environment chosen."""

    environment: str
    sources: dict[str, dict[str, Source]]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.sources[name][self.environment].read(spark)
