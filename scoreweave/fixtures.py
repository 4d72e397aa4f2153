"""Scoring-domain views derived from the generic test tables.

The SQL text is valid in Spark and in DuckDB and yields the same rows in both.
Orders play the application role, line items the credit-record role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import spread_small

APPLICATION = """
SELECT
  o_orderkey AS sk_id_curr,
  CASE WHEN ((o_orderkey * 7919) % 997) / 997e0
            < 2e-2 + 3e-1 * (1e0 - ((o_orderkey * 104729) % 1000) / 1000e0)
                          * (1e0 - ((o_orderkey * 104729) % 1000) / 1000e0)
       THEN 1 ELSE 0 END AS target,
  o_orderpriority AS name_contract_type,
  CASE WHEN o_custkey % 37 = 0 THEN NULL
       WHEN o_custkey % 41 = 0 THEN 0e0
       WHEN o_custkey % 43 = 0 THEN -1e0 * o_totalprice
       ELSE o_totalprice * 5e-1 + 20000e0 END AS amt_income_total,
  CASE WHEN o_orderkey % 53 = 0 THEN -1e0 * o_totalprice ELSE o_totalprice END AS amt_credit,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice / 16e0 END AS amt_annuity,
  CASE WHEN o_orderkey % 211 = 0 THEN 0e0
       ELSE -1e0 * (7300 + (o_orderkey * 31) % 18000) END AS days_birth,
  CASE WHEN o_orderkey % 11 = 0 THEN 365243e0
       WHEN o_orderkey % 97 = 0 THEN 10e0
       WHEN o_orderkey % 23 = 0 THEN NULL
       ELSE -1e0 * ((o_orderkey * 17) % 12000) END AS days_employed,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE ((o_orderkey * 104729) % 1000) / 1000e0 END AS ext_source_1,
  CASE WHEN o_orderkey % 89 = 0 THEN 15e-1
       ELSE ((o_orderkey * 613) % 1000) / 1000e0 END AS ext_source_2,
  ((o_orderkey * 104729) % 1000 + (o_orderkey * 271) % 1000) / 2000e0 AS ext_source_3
FROM orders
"""

BUREAU = """
SELECT
  l_orderkey * 10 + l_linenumber AS sk_id_bureau,
  CASE WHEN l_partkey % 101 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS sk_id_curr,
  CASE WHEN l_linenumber = 7 THEN NULL
       WHEN l_linestatus = 'O' THEN 'Active' ELSE 'Closed' END AS credit_active,
  CAST(l_quantity * -50e0 AS INT) AS days_credit,
  CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS amt_credit_sum,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice / 4e0 END AS amt_credit_sum_debt,
  CASE WHEN l_linenumber = 6 THEN NULL
       WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) ELSE 0 END AS credit_day_overdue
FROM lineitem
"""

SCORED = """
SELECT
  sk_id_curr,
  target,
  ((u * u - (u * u) % 20000) / 20000e0 + 1e0) / 100e0 AS p_base,
  ((u * u + w - (u * u + w) % 10000) / 10000e0 + 1e0) / 200e0 AS p_challenger
FROM (
  SELECT sk_id_curr, target,
         1000 - (sk_id_curr * 104729) % 1000 AS u,
         (sk_id_curr * 613) % 100000 AS w
  FROM application
) t
"""


def _over(spark: SparkSession, text: str, source: str, df: DataFrame) -> DataFrame:
    return spark.sql(text.replace(f"FROM {source}", "FROM {src}"), src=df)


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spread_small(_over(spark, APPLICATION, "orders", orders), "sk_id_curr")


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spread_small(_over(spark, BUREAU, "lineitem", lineitem), "sk_id_curr")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, SCORED, "application", application(spark, sf_dir))
