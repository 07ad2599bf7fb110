"""The driver's tables, and disclosure programs laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores: narrow rows of a small file would else be worked on by one task, however much each costs."""
    return rows.repartition(max(64, 4 * rows.sparkSession.sparkContext.defaultParallelism))


def small_batches(rows: DataFrame) -> DataFrame:
    """The same rows, which go to Python in batches of 4 MB and 1000 rows at most: memory of a task hangs on neither the table nor the lengths of its texts."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return rows


def perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: an order with its customer; nation and customer are small dimensions of it."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("case_number"), F.col("o_orderstatus").alias("case_status"), F.year("o_orderdate").alias("fiscal_year"), F.to_date("o_orderdate").alias("decision_date"),
            F.col("c_name").alias("employer_name"), F.col("n_name").alias("employer_state"), F.col("c_mktsegment").alias("law_firm"), F.col("o_orderpriority").alias("soc_title"),
            F.when(F.col("o_orderpriority").startswith("1"), "Professional").when(F.col("o_orderpriority").startswith("2"), "Professional").otherwise("Other").alias("occupation_type"), F.col("o_totalprice").alias("wage_from"),
        )
    )


PERM_SQL = """SELECT o_orderkey AS case_number, o_orderstatus AS case_status, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(o_orderdate AS DATE) AS decision_date,
  c_name AS employer_name, n_name AS employer_state, c_mktsegment AS law_firm, o_orderpriority AS soc_title,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'Professional' ELSE 'Other' END AS occupation_type, o_totalprice AS wage_from
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labor conditions: a line item with its supplier."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("l_orderkey").alias("case_number"), F.col("l_returnflag").alias("case_status"), F.year("l_shipdate").alias("fiscal_year"), F.to_date("l_shipdate").alias("decision_date"),
        F.col("s_name").alias("employer_name"), F.col("l_linestatus").alias("wage_source"), F.concat(F.lit("H"), F.col("l_linenumber").cast("string")).alias("visa_class"),
        F.when(F.col("l_discount") > 0.05, "Yes").otherwise("No").alias("h1b_dependent"), F.concat(F.lit("15-"), (F.col("l_partkey") % 20).cast("string")).alias("soc_title"),
        F.concat(F.lit("Firm "), (F.col("l_suppkey") % 10).cast("string")).alias("law_firm"), F.col("l_quantity").alias("total_worker_positions"), F.col("l_extendedprice").alias("wage_from"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("prevailing_wage"),
    )


LCA_SQL = """SELECT l_orderkey AS case_number, l_returnflag AS case_status, CAST(year(l_shipdate) AS INT) AS fiscal_year, CAST(l_shipdate AS DATE) AS decision_date,
  s_name AS employer_name, l_linestatus AS wage_source, 'H' || l_linenumber AS visa_class, CASE WHEN l_discount > 0.05 THEN 'Yes' ELSE 'No' END AS h1b_dependent,
  '15-' || (l_partkey % 20) AS soc_title, 'Firm ' || (l_suppkey % 10) AS law_firm, l_quantity AS total_worker_positions, l_extendedprice AS wage_from, l_extendedprice * (1 - l_discount) AS prevailing_wage
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


def pw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wage determinations: a line item, with the suggested code and the code assigned."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("case_number"), F.year("l_shipdate").alias("fiscal_year"), F.col("l_returnflag").alias("suggested_soc_code"),
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("pwd_soc_code"), F.concat(F.lit("Level "), F.col("l_linenumber").cast("string")).alias("pw_wage_level"),
        F.when(F.col("l_tax") > 0.04, "Survey").otherwise("OEWS").alias("wage_source"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("Survey "), (F.col("l_suppkey") % 5).cast("string"))).alias("survey_name"),
        F.concat(F.lit("Firm "), (F.col("l_suppkey") % 10).cast("string")).alias("law_firm"), F.col("l_extendedprice").alias("pwd_wage_rate"),
    )


PW_SQL = """SELECT l_orderkey AS case_number, CAST(year(l_shipdate) AS INT) AS fiscal_year, l_returnflag AS suggested_soc_code, CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE l_linestatus END AS pwd_soc_code,
  'Level ' || l_linenumber AS pw_wage_level, CASE WHEN l_tax > 0.04 THEN 'Survey' ELSE 'OEWS' END AS wage_source, CASE WHEN l_tax > 0.04 THEN 'Survey ' || (l_suppkey % 5) END AS survey_name,
  'Firm ' || (l_suppkey % 10) AS law_firm, l_extendedprice AS pwd_wage_rate FROM lineitem"""

PROGRAMS = {"perm": (perm, PERM_SQL), "lca": (lca, LCA_SQL), "pw": (pw, PW_SQL)}
