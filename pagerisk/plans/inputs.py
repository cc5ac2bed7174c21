"""Inputs the queries run on, all derived from the given tables.

Each Spark frame has a SQL twin: a common table expression for the oracle.
Constants are exact in both dialects and exponent literals keep both in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = ("url", "text", "js", "dom")

LABEL = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"
SPLIT = "CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 < 9 THEN 'val' ELSE 'test' END"
PROB = {
    "url": "CAST((id * 7919) % 1000 AS DOUBLE) / 1e3 * 6e-1 + 4e-1 * label",
    "text": "CASE WHEN id % 11 <> 3 THEN CAST((id * 104729) % 997 AS DOUBLE) / 997e0 END",
    "js": "CASE WHEN id % 7 <> 0 THEN CAST((id * 31 + user_id) % 21 AS DOUBLE) / 20e0 END",
    "dom": "CASE WHEN user_id % 5 <> 0 THEN CAST((user_id * 37 + id) % 101 AS DOUBLE) / 1e2 * 8e-1 + 2e-1 * label END",
}

# --- SQL twins -------------------------------------------------------------

GOLD_CTE = f"gold AS (SELECT event_id AS id, user_id, {LABEL} AS label, {SPLIT} AS split, ts FROM events)"

WIDE_CTE = (
    GOLD_CTE
    + ", wide AS (SELECT id, user_id, label, split, "
    + ", ".join(f"{PROB[h]} AS {h}" for h in HEADS)
    + " FROM gold)"
)

PREDS_CTE = (
    WIDE_CTE
    + ", preds AS ("
    + " UNION ALL ".join(
        f"SELECT id, label, split, '{h}' AS model, {h} AS prob FROM wide WHERE {h} IS NOT NULL" for h in HEADS
    )
    + ")"
)

CURVE_CTE = (
    PREDS_CTE
    + """, g AS (SELECT model, split, prob AS score, count(*) AS n, sum(label)::BIGINT AS pos FROM preds GROUP BY model, split, prob),
c AS (SELECT model, split, score, n, pos,
  sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos,
  sum(n) OVER (PARTITION BY model, split) AS tot_n, sum(pos) OVER (PARTITION BY model, split) AS tot_pos
  FROM g WINDOW w AS (PARTITION BY model, split ORDER BY score DESC)),
rates AS (SELECT *, cum_pos::DOUBLE / cum_n AS precision, cum_pos::DOUBLE / tot_pos AS recall,
  (cum_n - cum_pos)::DOUBLE / (tot_n - tot_pos) AS fpr FROM c)"""
)

DUP_CTE = """dup AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  ('0x' || substr(md5(concat_ws('|', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))), 1, 15))::BIGINT AS pos,
  l_quantity / 5e1 AS url, least(1e0, l_discount * 1e1) AS text, least(1e0, l_tax * 125e-1) AS js FROM lineitem),
dup_preds AS (SELECT id, label, 'url' AS model, url AS prob, pos FROM dup
  UNION ALL SELECT id, label, 'text', text, pos FROM dup
  UNION ALL SELECT id, label, 'js', js, pos FROM dup)"""


class Tables:
    """The given tables and the inputs Spark derives from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def gold(self) -> DataFrame:
        """Canonical rows: id, user_id, label, split, ts."""
        return self("events").selectExpr("event_id AS id", "user_id", f"{LABEL} AS label", f"{SPLIT} AS split", "ts")

    def wide(self) -> DataFrame:
        """One row per id with one nullable probability column per head."""
        return self.gold().selectExpr("id", "user_id", "label", "split", *[f"{PROB[h]} AS {h}" for h in HEADS])

    def preds(self) -> DataFrame:
        """Long prediction table from a single scan: id, label, split, model, prob."""
        entries = ", ".join(f"named_struct('model', '{h}', 'prob', {h})" for h in HEADS)
        return (
            self.wide()
            .selectExpr("id", "label", "split", f"inline(array({entries}))")
            .filter(F.col("prob").isNotNull())
        )

    def dup_preds(self) -> DataFrame:
        """Predictions with repeated ids, from lineitem; ``pos`` orders the copies of an id."""
        base = self("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS id",
            "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
            "CAST(conv(substr(md5(concat_ws('|', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))), 1, 15), 16, 10) AS BIGINT) AS pos",
            "l_quantity / 5e1 AS url", "least(1e0, l_discount * 1e1) AS text", "least(1e0, l_tax * 125e-1) AS js",
        )
        entries = ", ".join(f"named_struct('model', '{h}', 'prob', {h})" for h in ("url", "text", "js"))
        return base.selectExpr("id", "label", f"inline(array({entries}))", "pos")


def r6(column, name: str):
    """Round to six places and name the result, as the oracle does."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name)
