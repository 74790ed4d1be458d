"""Inputs of the registered queries, made from the driver's tables.

Each text runs on Spark and on DuckDB alike, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: Four models answer each item: orders 4k to 4k+3 are the answers to item k, their lines the constraint results.
RESULTS = """
SELECT 'm' || CAST(l_orderkey % 4 AS STRING) AS model,
       'T' || CAST(k % 5 + 1 AS STRING) || '.' || CAST(k % 3 + 1 AS STRING) || '-' || CAST(k AS STRING) AS item_id,
       i AS constraint_index,
       CASE (k + i) % 9 WHEN 0 THEN 'FP1' WHEN 1 THEN 'FP3' WHEN 2 THEN 'EG1' WHEN 3 THEN 'EG5' WHEN 4 THEN 'RC2' WHEN 5 THEN 'DB2' WHEN 6 THEN 'DB4' WHEN 7 THEN 'QV5' ELSE NULL END AS tag,
       CASE WHEN (k + i) % 3 = 0 THEN 'soft' ELSE 'hard' END AS type,
       CASE WHEN (k + i) % 3 = 0 THEN 'llm' WHEN i % 2 = 0 THEN 'rule_aided:min_words' ELSE 'rule_aided:table_columns' END AS method,
       CASE WHEN flag = 'R' THEN 0 WHEN flag = 'A' THEN 1 WHEN qty > 35 THEN NULL ELSE 1 END AS score
FROM (SELECT l_orderkey, CAST(FLOOR(l_orderkey / 4) AS BIGINT) AS k, CAST(l_linenumber - 1 AS BIGINT) AS i, MAX(l_returnflag) AS flag, MAX(l_quantity) AS qty
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS x
"""

QUALITY = """
SELECT 'm' || CAST(o_orderkey % 4 AS STRING) AS model,
       'T' || CAST(k % 5 + 1 AS STRING) || '.' || CAST(k % 3 + 1 AS STRING) || '-' || CAST(k AS STRING) AS item_id,
       CAST(o_custkey % 11 AS BIGINT) AS quality
FROM (SELECT o_orderkey, o_custkey, CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS k FROM {orders}) AS x
"""

#: One answer for each order: JSON for every seventh, else Markdown whose parts depend on remainders of the key.
RESPONSES = """
SELECT o_orderkey AS item_id,
  CASE WHEN o_orderkey % 7 = 0 THEN
    CASE WHEN o_orderkey % 14 = 0 THEN '```json5' || nl ELSE '' END
    || '{{"order": ' || CAST(o_orderkey AS STRING) || ', "status": "' || o_orderstatus || '", "tags": ["a", "bb", "' || o_orderpriority || '"]}}'
    || CASE WHEN o_orderkey % 14 = 0 THEN nl || '```' ELSE '' END
  ELSE CASE o_orderkey % 4 WHEN 0 THEN '# Order ' WHEN 1 THEN '**Order ' WHEN 2 THEN '1. Order ' ELSE 'Order ' END || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 4 = 1 THEN '**' ELSE '' END || nl || nl
    || 'Summary: status ' || o_orderstatus || ' and priority ' || o_orderpriority || '. Please review it today! Is it ready? We think so.' || nl || nl
    || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '| Item | **Qty** |' || nl || '| --- | :---: |' || nl || '| A | ' || CAST(o_custkey % 50 AS STRING) || ' |' || nl || '| B | 7 |' || nl || CASE WHEN o_orderkey % 3 = 2 THEN '| C | 9 |' || nl ELSE '' END || nl END
    || CASE WHEN o_orderkey % 5 = 4 THEN '    ## Details' ELSE '  ## Details' END || nl || nl
    || '- total ' || CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING) || '.25 USD' || nl
    || '+ share ' || CAST(o_custkey % 100 AS STRING) || '.5' || CASE WHEN o_orderkey % 11 = 0 THEN '%' ELSE ' percent' END || nl
    || CASE WHEN o_orderkey % 2 = 0 THEN '1. check stock' || nl || '2) ship it' || nl ELSE '' END || nl
    || CASE WHEN o_orderkey % 5 = 0 THEN '> quoted note' || nl || '>bare' || nl || '```' || nl || 'code' || nl || '```' || nl ELSE '' END
    || CASE o_orderkey % 6 WHEN 0 THEN '- [x] done' || nl WHEN 3 THEN '[ ]' || nl ELSE '' END
    || CASE WHEN o_orderkey % 8 = 1 THEN 'Risk & scope:' || nl ELSE '' END
    || CASE WHEN o_orderkey % 9 = 0 THEN '本报告认为 5 亿元' || nl ELSE '' END
    || CASE o_orderkey % 10 WHEN 0 THEN '以上内容仅供参考，不构成投资建议' WHEN 5 THEN '风险提示' ELSE 'Closing for ' || o_orderpriority || '.' END
  END AS response
FROM (SELECT *, CHR(10) AS nl FROM {orders}) AS x
"""

#: What the answers' parts are, for closed forms of what is measured on them: k the key, j JSON, np one word more in the priority.
FACTS = """
SELECT o_orderkey AS item_id, o_orderkey AS k, o_orderkey % 7 = 0 AS j, CASE WHEN o_orderpriority LIKE '4%' THEN 1 ELSE 0 END AS np,
       o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS tp FROM {orders}
"""


def spark_rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the tables of sf_dir."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The text over tables of the same names."""
    return text.format(**{t: t for t in TABLES})


def with_sql(query: str, **parts: str) -> str:
    """query with the named inputs in front of it."""
    if not parts:
        return query
    return "WITH " + ", ".join(f"{name} AS ({duck(text)})" for name, text in parts.items()) + " " + query
