"""Report tables and merged metric artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = 100_000


def write_report(table: DataFrame, path: str) -> None:
    """One CSV file. Reports hold a row per model, split or threshold, never one per page."""
    if table.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError("a report is a small table; write large results as Parquet")
    table.coalesce(1).write.option("header", True).csv(path)


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def markdown(table: DataFrame, limit: int | None = None) -> str:
    """A report as a Markdown table; ``limit`` cuts it and says so below the rows. Large tables are refused."""
    most = REPORT_ROWS if limit is None else limit
    rows = table.limit(most + 1).collect()
    if len(rows) > most and limit is None:
        raise ValueError("a report is a small table; give a limit to show its first rows")
    more, rows = len(rows) > most, rows[:most]
    head = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows] + ([f"\nThe first {most} rows."] if more else []))


def merge_artifacts(spark: SparkSession, base: str, runs: Sequence[str], schema: str) -> DataFrame:
    """Metric files of several runs as one table tagged by run; the path pattern skips absent runs."""
    rows = spark.read.schema(schema).json(f"{base.rstrip('/')}/{{{','.join(runs)}}}")
    run = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.withColumn("run", run)
