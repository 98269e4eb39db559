"""Messy tables derived from the given ones. One SQL text builds the same rows in Spark and in
the SQL oracle; ``{customer}`` and the like stand for the source tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import balanced, read_table

MC = """
SELECT
  lpad(CAST(c_custkey AS STRING), 6, '0') AS customer_id,
  CASE WHEN c_custkey % 3 = 0 THEN '  ' || lower(c_name) || ' ' WHEN c_custkey % 3 = 1 THEN upper(c_name) ELSE c_name END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'bad-email'
       WHEN c_custkey % 5 = 0 THEN ' USER' || CAST(c_custkey AS STRING) || '@Example.COM '
       ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN '123'
       WHEN c_custkey % 4 = 0 THEN '+91 98765 ' || lpad(CAST(c_custkey AS STRING), 5, '0')
       WHEN c_custkey % 4 = 1 THEN '98765' || lpad(CAST(c_custkey AS STRING), 5, '0') || '.0'
       WHEN c_custkey % 4 = 2 THEN '0091-98765' || lpad(CAST(c_custkey AS STRING), 5, '0')
       ELSE '98765' || lpad(CAST(c_custkey AS STRING), 5, '0') END AS phone,
  CASE WHEN c_custkey % 17 = 0 THEN '150' WHEN c_custkey % 19 = 0 THEN 'N/A' WHEN c_custkey % 23 = 0 THEN 'five'
       ELSE CAST(18 + c_custkey % 60 AS STRING) END AS age,
  CASE WHEN c_custkey % 29 = 0 THEN ' -- ' WHEN c_custkey % 10 = 0 THEN '₹' || CAST(1 + c_custkey % 9 AS STRING) || ',500'
       WHEN c_custkey % 10 = 1 THEN '$' || CAST(c_acctbal AS STRING) ELSE CAST(c_acctbal AS STRING) END AS amount,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 101 AS STRING) || '%'
       ELSE CAST(CAST(c_custkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS STRING) END AS conversion_rate,
  CASE c_custkey % 6 WHEN 0 THEN 'Active' WHEN 1 THEN 'active' WHEN 2 THEN 'ACTIVE' WHEN 3 THEN 'Inactive' WHEN 4 THEN ' Active ' ELSE 'Active' END AS status,
  CASE c_custkey % 6 WHEN 0 THEN 'HR' WHEN 1 THEN 'Human Resources' WHEN 2 THEN 'IT' WHEN 3 THEN 'mktg' WHEN 4 THEN 'Sales' ELSE 'ops' END AS department,
  CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'f' WHEN 2 THEN 'Male' WHEN 3 THEN 'woman' WHEN 4 THEN ' O ' ELSE NULL END AS gender,
  CASE c_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' ELSE 'N' END AS is_active,
  CASE c_custkey % 4 WHEN 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')
       WHEN 1 THEN lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '/15/2023'
       WHEN 2 THEN CAST(13 + c_custkey % 15 AS STRING) || '/02/2023'
       ELSE CAST(1 + c_custkey % 28 AS STRING) || ' January 2022' END AS joined,
  c_mktsegment AS segment,
  'free text ' || CAST(c_custkey AS STRING) AS notes,
  CAST(NULL AS STRING) AS blank_col,
  'x' AS const_col
FROM {customer}
"""

# every rich customer twice, and one all-NULL row per region
MC_DUP = f"""
SELECT * FROM ({MC}) mc_all
UNION ALL SELECT * FROM ({MC.replace("FROM {customer}", "FROM {customer} WHERE c_acctbal > 9000")}) mc_rich
UNION ALL SELECT {", ".join(["CAST(NULL AS STRING)"] * 16)} FROM {{region}}
"""

MO = """
SELECT k AS order_id, l_partkey,
  CASE k % 6 WHEN 0 THEN 'blr' WHEN 1 THEN 'New Delhi' WHEN 2 THEN ' mumbai' WHEN 3 THEN 'Pune' WHEN 4 THEN 'Mysore' ELSE 'Atlantis' END AS city,
  CASE k % 4 WHEN 0 THEN 'Karnataka' WHEN 1 THEN 'Delhi' WHEN 2 THEN 'Karnataka' ELSE NULL END AS state,
  CASE WHEN k % 31 = 0 THEN '-1' WHEN k % 37 = 0 THEN 'two' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity,
  CASE WHEN k % 41 = 0 THEN '₹' ELSE '' END
    || CAST(floor(l_extendedprice / l_quantity * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS STRING) AS unit_price,
  CASE k % 3 WHEN 0 THEN CAST(CAST(floor(abs(l_discount) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT) AS STRING) || '%'
             WHEN 1 THEN CAST(CAST(floor(abs(l_discount) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT) AS STRING)
             ELSE CAST(abs(l_discount) AS STRING) END AS discount,
  CASE WHEN k % 10 = 0 THEN '1.00'
       ELSE CAST(floor(l_extendedprice * (CAST(1 AS DOUBLE) - abs(l_discount)) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS STRING) END AS sales,
  CAST(k % 7 AS INT) AS rating,
  CASE k % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'Completed' WHEN 2 THEN 'return' WHEN 3 THEN 'pending ' WHEN 4 THEN 'SHIPPED' ELSE 'cancelled' END AS order_status,
  CASE k % 4 WHEN 0 THEN 'creditcard' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'UPI' ELSE 'net-banking' END AS payment_method,
  CASE k % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'App' WHEN 2 THEN 'market place' ELSE 'store' END AS sales_channel,
  CASE k % 5 WHEN 0 THEN 'electronics' WHEN 1 THEN 'Electronics' WHEN 2 THEN 'electronic' WHEN 3 THEN 'accessory' ELSE 'Accessories' END AS category
FROM (SELECT *, (l_orderkey * 8 + l_linenumber) AS k FROM {lineitem}) keyed
"""

# one label column per rule of the label operators
ML = """
SELECT
  CASE k % 7 WHEN 0 THEN 'Web Site' WHEN 1 THEN 'web-site' WHEN 2 THEN 'web' WHEN 3 THEN 'Mobile App' WHEN 4 THEN 'mobileapp' WHEN 5 THEN 'market place' ELSE 'Marketplace' END AS channel,
  CASE WHEN k % 211 = 0 THEN 'enginering' WHEN k % 199 = 0 THEN 'Finnance' WHEN k % 5 < 2 THEN 'engineering' WHEN k % 5 = 2 THEN 'Engineering' WHEN k % 5 = 3 THEN 'finance' ELSE 'legal affairs' END AS division,
  CASE k % 6 WHEN 0 THEN 'laptop' WHEN 1 THEN 'Laptops' WHEN 2 THEN 'battery' WHEN 3 THEN 'Batteries' WHEN 4 THEN 'buses' ELSE 'laptops' END AS product_type,
  CASE k % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'C++' WHEN 2 THEN 'C#' WHEN 3 THEN 'c' ELSE 'A+' END AS skill,
  CASE k % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'YES' WHEN 2 THEN 'no' WHEN 3 THEN 'y' WHEN 4 THEN 'maybe' ELSE 'N' END AS is_member,
  CASE k % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN 'Non-Binary' WHEN 3 THEN 'other' ELSE 'unsaid' END AS customer_gender,
  CASE k % 5 WHEN 0 THEN 'Full-Time' WHEN 1 THEN 'fulltime' WHEN 2 THEN 'contractor' WHEN 3 THEN 'Contract' ELSE 'gig' END AS employment_type,
  CASE k % 4 WHEN 0 THEN 'bachelor''s degree' WHEN 1 THEN 'Bachelors' WHEN 2 THEN 'PhD' ELSE 'p.h.d' END AS education,
  state_like AS ship_state,
  'part ' || CAST(l_partkey AS STRING) AS part_note
FROM (SELECT l_partkey, (l_orderkey * 8 + l_linenumber) AS k,
        CASE WHEN l_returnflag = 'A' THEN 'new_york' WHEN l_returnflag = 'N' THEN 'New York' ELSE 'são paulo' END AS state_like
      FROM {lineitem}) keyed
"""

# typed customers with gaps, for the missing-value strategies
MT = """
SELECT lpad(CAST(c_custkey AS STRING), 6, '0') AS customer_id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_acctbal END AS points,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_custkey % 40 END AS visits,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 3 = 0 END AS member,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 10 < 4 THEN 'gold' WHEN c_custkey % 10 < 7 THEN 'silver' ELSE 'bronze' END AS grade,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'note ' || CAST(c_custkey AS STRING) END AS remark
FROM {customer}
"""
MT_KINDS = {"customer_id": "id", "email": "email", "points": "numeric", "visits": "numeric", "member": "boolean",
            "grade": "text", "remark": "text"}

# skewed measures, so that the IQR rule finds something
SK = """
SELECT l_orderkey, l_linenumber, l_quantity * l_quantity * l_extendedprice AS load,
  CASE WHEN l_quantity > 49 THEN l_extendedprice * 10 ELSE l_extendedprice END AS unit_price, l_tax
FROM {lineitem}
"""

# identifiers of numeric types, to be kept as text with every digit
MI = """
SELECT lpad(CAST(c_custkey AS STRING), 6, '0') AS customer_id, CAST(c_custkey AS DOUBLE) + CAST(0.25 AS DOUBLE) AS tax_code,
  CAST(c_custkey AS DOUBLE) * CAST(10000000 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS sku_code,
  CAST(CAST(c_custkey % 3 + 1 AS STRING) || 'E39' AS DOUBLE) AS ledger_code,
  CAST(CAST(c_custkey AS STRING) || '.1250' AS DECIMAL(14, 4)) AS postal_code
FROM {customer}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return balanced(read_table(spark, f"{folder}/{name}.parquet"))


def from_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """The same text for the SQL engine, where the tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.strip()
