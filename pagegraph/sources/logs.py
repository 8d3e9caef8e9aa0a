"""Log sources and sinks: saved workflow states and metric lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SCHEMA = (
    "workflow_id STRING, current_step BIGINT, status STRING, start_time TIMESTAMP_NTZ, last_update TIMESTAMP_NTZ, "
    "variables MAP<STRING, STRING>, step_results ARRAY<STRUCT<step_name: STRING, success: BOOLEAN, output: STRING, "
    "error: STRING, execution_time_ms: BIGINT, timestamp: TIMESTAMP_NTZ>>"
)


def read_workflow_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per executed step of saved states (JSON lines)."""
    return explode_states(spark.read.schema(STATE_SCHEMA).json(path))


def explode_states(states: DataFrame) -> DataFrame:
    return states.select(
        "workflow_id", "status", F.size("variables").alias("n_variables"), F.posexplode("step_results").alias("step", "r")
    ).select("workflow_id", "status", "n_variables", "step", "r.*")


def write_metric_lines(lines: DataFrame, path: str) -> None:
    """Text exposition: one metric per line."""
    lines.select("line").write.text(path)
