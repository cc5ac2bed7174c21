"""JSON-lines tables (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Parse JSON text; a line that is no JSON object is kept whole in ``_corrupt_record``."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.filter(F.trim(column) != "").select(parsed.alias("r")).select("r.*")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2: malformed lines are dropped; ``count_malformed`` tells how many."""
    rows = parse_lines(spark.read.text(path), schema)
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def count_malformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = parse_lines(spark.read.text(path), schema)
    return rows.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed")
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """A3: null fields are left out of each object."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)
