"""Queries beside their SQL twins on tables with repeats and odd values that the given ones lack."""

import glob
import os

import pytest
from compare import compare, connect

from pagerisk.plans import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def beside_sql(spark, tmp_path, name, **changed):
    """Compare one query on copies of the tables, of which ``changed`` are made by SQL."""
    con = connect(SF)
    for path in glob.glob(f"{SF}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        if table in changed:
            con.execute(f"COPY ({changed[table]}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        else:
            os.symlink(path, f"{tmp_path}/{table}.parquet")
    status, _, note = compare(spark, connect(str(tmp_path)), str(tmp_path), queries()[name], oracle_sql()[name])
    assert status == "ok", note


def test_feed_scan_keeps_repeated_urls(spark, tmp_path):
    beside_sql(spark, tmp_path, "a4_any_feed_scan", pages="SELECT page_id * 2 + i AS page_id, url, html FROM pages, (SELECT unnest([0, 1]) AS i)")


def test_cut_references_in_titles(spark, tmp_path):
    beside_sql(spark, tmp_path, "m1_html_features", pages="SELECT page_id, url, replace(html, '</title>', ' &amp</title>') AS html FROM pages")
