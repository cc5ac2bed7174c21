"""URL feeds (A4-A12, H1): text, CSV and zip files to ``(url, label, source, pos)`` rows."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerisk.functions import urls as u
from pagerisk.operators.running import even_bucket, ranked


def with_position(df: DataFrame, *columns: Column) -> DataFrame:
    """Rows of files with their reading order: file name, block start, order in the block."""
    return df.select(
        *columns,
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("pos"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty, non-comment lines in reading order."""
    rows = with_position(spark.read.text(path), F.col("value"))
    return rows.withColumn("value", F.trim("value")).filter("value <> '' AND value NOT LIKE '#%'")


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).filter(F.trim("value") != "").first()
    return row.value if row else ""


ZIP_LINES = "value STRING, pos STRUCT<file: STRING, block: BIGINT, row: BIGINT>"


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """A4: the first CSV member, else the first text member, of each archive, as lines with their position.

    An archive is read by one task, as its format asks for; lines leave it in blocks.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    names = sorted(z.namelist())
                    pick = next((n for e in (".csv", ".txt") for n in names if n.lower().endswith(e)), None)
                    if pick is None:
                        continue
                    with z.open(pick) as f:
                        lines = io.TextIOWrapper(f, encoding="utf-8", errors="ignore")
                        for block in itertools.count():
                            part = [line.rstrip("\r\n") for line in itertools.islice(lines, 50_000)]
                            if not part:
                                break
                            place = pa.StructArray.from_arrays(
                                [pa.array([name.rsplit("/", 1)[-1]] * len(part)), pa.array([block] * len(part), pa.int64()), pa.array(range(len(part)), pa.int64())],
                                ["file", "block", "row"],
                            )
                            yield pa.RecordBatch.from_pydict({"value": pa.array(part, pa.string()), "pos": place})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, ZIP_LINES)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """A4: any feed file to ``(url, pos)``: zip, CSV with a url, domain or host column, or one URL per line."""
    if path.lower().endswith(".zip"):
        lines = read_zip(spark, path)
        row = lines.first()
        header = row.value if row else ""
    else:
        lines, header = None, first_line(spark, path)
    fields = [f.strip().strip('"').lower() for f in next(csv.reader([header]), [])]
    column = next((fields.index(c) for c in ("url", "domain", "host") if c in fields), None)
    if lines is None:
        lines = with_position(spark.read.text(path), F.col("value"))
    if column is not None and len(fields) > 1:
        schema = ", ".join(f"c{i} STRING" for i in range(len(fields)))
        value = F.from_csv("value", F.lit(schema))[f"c{column}"]
        rows = lines.filter(F.col("value") != header).select(F.trim(value).alias("url"), "pos")
    else:
        rows = lines.select(F.trim("value").alias("url"), "pos")
        low = F.lower("url")
        rows = rows.filter(~low.isin("url", "domain", "host") & ~low.startswith("url,"))
    return rows.filter("url IS NOT NULL AND url <> ''")


def blocklist(lines: DataFrame) -> DataFrame:
    """Domain blocklist lines to canonical ``http://domain/`` URLs of label 1."""
    d = F.regexp_replace(F.replace(F.col("value"), F.lit("0.0.0.0 "), F.lit("")), r"^\|+", "")
    d = F.trim(F.regexp_replace(d, r"\^+$", ""))
    rows = lines.select(d.alias("domain"), "pos").filter("domain LIKE '%.%' AND domain NOT LIKE '% %'")
    return rows.select(u.canonical(F.concat(F.lit("http://"), "domain", F.lit("/"))).alias("url"), F.lit(1).alias("label"), "pos")


def csv_named(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """CSV by column name with ``#`` comment lines."""
    rows = spark.read.option("comment", "#").option("header", True).csv(path)
    return rows.select(u.canonical(F.col(column)).alias("url"), F.lit(1).alias("label")).filter("url <> ''")


def csv_positional(spark: SparkSession, path: str, url_at: int = 1, threat_at: int | None = None, word: str | None = None, width: int = 5) -> DataFrame:
    """Headerless CSV; optionally only rows whose threat column holds a word."""
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    rows = spark.read.schema(schema).option("comment", "#").csv(path)
    if word is not None:
        rows = rows.filter(F.lower(f"c{threat_at}").contains(word))
    raw = F.trim(f"c{url_at}")
    named = rows.filter(F.coalesce(raw, F.lit("")) != "").filter(~F.lower(raw).isin("url"))
    return with_position(named, u.canonical(raw).alias("url"), F.lit(1).alias("label"))


def yearly(spark: SparkSession, path: str) -> DataFrame:
    """Yearly files, newest first: ``year`` from the file path, rank by year descending."""
    rows = csv_positional(spark, path).withColumn("year", F.regexp_extract(F.input_file_name(), r"(20[0-9]{2})", 1).cast("int"))
    return rows.withColumn("file_rank", -F.col("year"))


def ranked_sites(rows: DataFrame, n: int) -> DataFrame:
    """The n best ranked domains as benign seeds; ranks may have gaps, ties go by domain."""
    top = ranked(rows, [], ["rank", "domain"], even_bucket(rows, "rank"), "place").filter(F.col("place") <= n)
    return top.select(u.canonical(F.concat(F.lit("https://"), "domain", F.lit("/"))).alias("url"), F.lit(0).alias("label"), "rank")


def tagged(rows: DataFrame, source: str, label: int, rank: int) -> DataFrame:
    """H1, B2: a feed tagged for union with others; ``source_rank`` is its precedence."""
    return rows.select(
        u.with_scheme(F.col("url")).alias("url"), F.lit(label).alias("label"), F.lit(source).alias("source"),
        F.lit(rank).alias("source_rank"), "pos").filter("url IS NOT NULL")


SEED = "url STRING, label INT, source STRING"


def write_seed(rows: DataFrame, path: str) -> None:
    """The seed table as CSV with a header."""
    rows.select("url", "label", "source").write.mode("overwrite").option("header", True).csv(path)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED).option("header", True).csv(path)
