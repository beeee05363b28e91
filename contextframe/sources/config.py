"""Settings files, read on the driver, and JSON state files, read as tables."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """The settings and what holds where a file says nothing."""

    skeleton_threshold_loc: int = 100
    max_output_lines: int = 50
    max_search_results: int = 20
    decay_rate: float = 0.05
    prune_threshold: float = 0.2
    prune_days: int = 30
    max_memories: int = 10
    confidence_threshold: int = 60
    confidence_action: str = "warn"
    loop_threshold: int = 3
    max_iterations: int = 5


def settings(path: str) -> Settings:
    """The settings of a TOML file, from any of its tables; all defaults if there is no such file."""
    file = Path(path)
    if not file.exists():
        return Settings()
    known = {f.name for f in fields(Settings)}
    found: dict = {}

    def take(table: dict) -> None:
        for name, value in table.items():
            if isinstance(value, dict):
                take(value)
            elif name in known:
                found[name] = value

    take(tomllib.loads(file.read_text(encoding="utf-8")))
    return Settings(**found)


def servers(path: str) -> dict:
    """Language servers of a JSON file by language; none if there is no such file."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}


def latest_state(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """The newest saved state of a project among the JSON files of a folder."""
    states = spark.read.json(folder)
    own = states.where(F.col("project") == project)
    names = [c for c in states.columns if c != "project"]
    return own.groupBy("project").agg(F.max_by(F.struct(*names), "saved_at").alias("s")).select("project", "s.*")


def append_json(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines."""
    df.write.mode("append").json(path)


def write_index(parts: dict[str, DataFrame], folder: str) -> None:
    """The tables of a code index, each in a Parquet folder of its own."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def merged_schema(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both tables; a column that one lacks is null there."""
    return one.unionByName(other, allowMissingColumns=True)
