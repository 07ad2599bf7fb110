"""Family A and the statistics beside it: pivots, raw pages, typeahead, statistics, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import with_related
from ..operators.pivot import Metric, PivotSpec, grand_total, mean, pivot, raw, raw_count, typeahead
from ..sources.tables import LCA_SQL, PERM_SQL, PROGRAMS, PW_SQL, lca, perm, pw, table
from .registry import _QUERIES, _SQL, query
from .templates import TEMPLATES, template_sql


def _template(name: str):
    program, spec = TEMPLATES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pivot(PROGRAMS[program][0](spark, sf_dir), spec)

    run.__name__ = f"template_{name}"
    return run, template_sql(PROGRAMS[program][1], spec)


for _name in TEMPLATES:
    _QUERIES[f"template_{_name}"], _SQL[f"template_{_name}"] = _template(_name)

_COUNT = Metric("count", None, "n")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def pivot_basic(spark, sf_dir):
    return pivot(table(spark, sf_dir, "orders"), PivotSpec(("o_orderstatus",), (_COUNT,)))


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share FROM orders GROUP BY 1")
def pivot_pct_total(spark, sf_dir):
    return pivot(table(spark, sf_dir, "orders"), PivotSpec(("o_orderstatus",), (_COUNT, Metric("pct_of_total", None, "share"))))


@query("""SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total,
  round(avg(o_totalprice)::DECIMAL(38,10), 2)::DOUBLE AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1""")
def pivot_all_aggs(spark, sf_dir):
    price = "o_totalprice"
    spec = PivotSpec(("o_orderpriority",), (_COUNT, Metric("pct_of_total", None, "pct"), Metric("count_distinct", "o_custkey", "customers"), Metric("sum", price, "total"), Metric("avg", price, "mean"), Metric("min", price, "low"), Metric("max", price, "high")))
    return pivot(table(spark, sf_dir, "orders"), spec).withColumn("total", F.round("total", 2))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F__n", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O__n", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P__n", count(*) AS "__row_total__n",
  round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) AS "F__pct", round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 2) AS "O__pct", round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 2) AS "P__pct",
  round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS "__row_total__pct" FROM orders GROUP BY 1""")
def pivot_columns(spark, sf_dir):
    return pivot(table(spark, sf_dir, "orders"), PivotSpec(("o_orderpriority",), (_COUNT, Metric("pct_of_total", None, "pct")), column="o_orderstatus"))


@query("""SELECT count(*) AS n, round(avg(o_totalprice)::DECIMAL(38,10), 2)::DOUBLE AS mean, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus <> 'P')) AS n_groups,
  (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus <> 'P')) > 3 AS "limited" FROM orders WHERE o_orderstatus <> 'P'""")
def pivot_grand_total(spark, sf_dir):
    return grand_total(table(spark, sf_dir, "orders"), PivotSpec(("o_orderpriority",), (_COUNT, Metric("avg", "o_totalprice", "mean")), filters=(("o_orderstatus", "!=", "P"),), limit=3))


@query("SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS fiscal_year, count(*) AS n FROM orders GROUP BY ALL")
def pivot_multi_row(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("fiscal_year", F.year("o_orderdate"))
    return pivot(orders, PivotSpec(("o_orderstatus", "o_orderpriority", "fiscal_year"), (_COUNT,), limit=5000))


@query(f"SELECT employer_state, count(*) AS n FROM ({PERM_SQL}) t WHERE employer_state ILIKE '%tion_2%' AND law_firm NOT ILIKE '%build%' AND wage_from >= 1000 GROUP BY 1")
def pivot_filters_ilike(spark, sf_dir):
    return pivot(perm(spark, sf_dir), PivotSpec(("employer_state",), (_COUNT,), filters=(("employer_state", "contains", "tion_2"), ("law_firm", "not_contains", "build"), ("wage_from", ">=", 1000))))


@query(f"SELECT wage_source, count(*) AS n FROM ({PW_SQL}) t WHERE survey_name IS NULL AND pw_wage_level IS NOT NULL GROUP BY 1")
def pivot_filters_null(spark, sf_dir):
    return pivot(pw(spark, sf_dir), PivotSpec(("wage_source",), (_COUNT,), filters=(("survey_name", "is_null"), ("pw_wage_level", "not_null"), ("", "="))))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 ORDER BY o_orderkey LIMIT 200")
def raw_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return raw(orders, PivotSpec(filters=(("o_orderstatus", "=", "F"), ("o_totalprice", ">", 50000)), limit=200), "o_orderkey")


@query("SELECT count(*) AS total, count(*) > 200 AS \"limited\" FROM orders WHERE o_orderstatus = 'F'")
def raw_count_limited(spark, sf_dir):
    return raw_count(table(spark, sf_dir, "orders"), PivotSpec(filters=(("o_orderstatus", "=", "F"),), limit=200))


@query("SELECT DISTINCT n_name AS value FROM nation WHERE n_name ILIKE '%tion_1%' ORDER BY 1 LIMIT 50")
def typeahead_values(spark, sf_dir):
    return typeahead(table(spark, sf_dir, "nation"), "n_name", "tion_1")


@query(f"""SELECT soc_title, case_status, count(*) AS n, round(avg(wage_from)::DECIMAL(38,10), 2)::DOUBLE AS mean, round(quantile_cont(wage_from, 0.5), 4) AS median, min(wage_from) AS low, max(wage_from) AS high FROM ({PERM_SQL}) t GROUP BY 1, 2""")
def stats_median(spark, sf_dir):
    return perm(spark, sf_dir).groupBy("soc_title", "case_status").agg(F.count("*").alias("n"), mean("wage_from").alias("mean"), F.round(F.percentile("wage_from", 0.5), 4).alias("median"), F.min("wage_from").alias("low"), F.max("wage_from").alias("high"))


@query(f"SELECT fiscal_year, count(DISTINCT employer_name) AS employers, count(DISTINCT law_firm) AS firms, count(DISTINCT soc_title) AS titles, count(*) AS n FROM ({PERM_SQL}) t GROUP BY 1")
def stats_multi_distinct(spark, sf_dir):
    return perm(spark, sf_dir).groupBy("fiscal_year").agg(F.count_distinct("employer_name").alias("employers"), F.count_distinct("law_firm").alias("firms"), F.count_distinct("soc_title").alias("titles"), F.count("*").alias("n"))


@query(f"SELECT law_firm, count(*) AS n, round(100.0 * sum(CASE WHEN case_status LIKE 'F%' THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS rate, count(*) FILTER (WHERE case_status = 'O') AS denied FROM ({PERM_SQL}) t GROUP BY 1")
def landing_rate(spark, sf_dir):
    certified = F.count_if(F.col("case_status").startswith("F"))
    return perm(spark, sf_dir).groupBy("law_firm").agg(F.count("*").alias("n"), F.round(100.0 * certified / F.count("*"), 1).alias("rate"), F.count_if(F.col("case_status") == "O").alias("denied"))


def _programs(spark, sf_dir):
    return {"perm": perm(spark, sf_dir), "lca": lca(spark, sf_dir), "pw": pw(spark, sf_dir)}


@query(f"""SELECT 'perm' AS program, count(*) AS n, count(DISTINCT law_firm) AS firms, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM ({PERM_SQL}) t
  UNION ALL SELECT 'lca', count(*), count(DISTINCT law_firm), min(fiscal_year), max(fiscal_year) FROM ({LCA_SQL}) t UNION ALL SELECT 'pw', count(*), count(DISTINCT law_firm), min(fiscal_year), max(fiscal_year) FROM ({PW_SQL}) t""")
def program_rollcall(spark, sf_dir):
    out = None
    for name, df in _programs(spark, sf_dir).items():
        row = df.agg(F.count("*").alias("n"), F.count_distinct("law_firm").alias("firms"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year")).withColumn("program", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""SELECT program, case_number, fiscal_year FROM (
  (SELECT 'lca' AS program, case_number, fiscal_year, decision_date, visa_class FROM ({LCA_SQL}) t WHERE employer_name = 'Supplier#000000001' ORDER BY decision_date DESC, case_number, visa_class LIMIT 100)
  UNION ALL (SELECT 'perm', case_number, fiscal_year, decision_date, NULL FROM ({PERM_SQL}) t WHERE employer_name = 'Customer#000000001' ORDER BY decision_date DESC, case_number LIMIT 100))""")
def employer_360(spark, sf_dir):
    a = lca(spark, sf_dir).where("employer_name = 'Supplier#000000001'").orderBy(F.desc("decision_date"), "case_number", "visa_class").limit(100).withColumn("program", F.lit("lca"))
    b = perm(spark, sf_dir).where("employer_name = 'Customer#000000001'").orderBy(F.desc("decision_date"), "case_number").limit(100).withColumn("program", F.lit("perm"))
    keep = ["program", "case_number", "fiscal_year"]
    return a.select(*keep).unionByName(b.select(*keep))


@query(f"""SELECT 'lca' AS program, law_firm, fiscal_year, count(*) AS n FROM ({LCA_SQL}) t WHERE law_firm ILIKE '%firm 1%' GROUP BY 2, 3 UNION ALL SELECT 'pw', law_firm, fiscal_year, count(*) FROM ({PW_SQL}) t WHERE law_firm ILIKE '%firm 1%' GROUP BY 2, 3
  UNION ALL SELECT 'perm', law_firm, fiscal_year, count(*) FROM ({PERM_SQL}) t WHERE law_firm ILIKE '%firm 1%' GROUP BY 2, 3""")
def firm_rollup(spark, sf_dir):
    out = None
    for name, df in _programs(spark, sf_dir).items():
        part = df.where(F.col("law_firm").ilike("%firm 1%")).groupBy("law_firm", "fiscal_year").agg(F.count("*").alias("n")).withColumn("program", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT employer_name, count(*) AS n FROM ({PERM_SQL}) t GROUP BY 1 ORDER BY n DESC, employer_name LIMIT 10")
def topn_groups(spark, sf_dir):
    return perm(spark, sf_dir).groupBy("employer_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "employer_name").limit(10)


@query(f"SELECT law_firm, count(*) AS n, round(100.0 * avg(CASE WHEN suggested_soc_code <> pwd_soc_code THEN 1.0 ELSE 0.0 END), 2) AS drift FROM ({PW_SQL}) t GROUP BY 1")
def soc_drift_rate(spark, sf_dir):
    changed = F.when(F.col("suggested_soc_code") != F.col("pwd_soc_code"), 1.0).otherwise(0.0)
    return pw(spark, sf_dir).groupBy("law_firm").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(changed), 2).alias("drift"))


@query("""SELECT event_type, user_id, count(*) AS n, round(avg(value)::DECIMAL(38,10), 2)::DOUBLE AS mean, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END)::BIGINT AS zero_results, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id LIMIT 100""")
def search_events_common(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    recent = events.join(F.broadcast(events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))), F.col("ts") >= F.col("since"))  # one row
    found = recent.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), mean("value").alias("mean"), F.count_if(F.col("value") < 10).alias("zero_results"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    return found.orderBy(F.desc("n"), "event_type", "user_id").limit(100)


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def left_join_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(counts, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0).cast("bigint")))


@query("SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def fanout_distinct_counts(spark, sf_dir):
    """Each side is counted before the join, so the product of both never exists."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    out = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return out.fillna(0, ["customers", "suppliers"])


def _parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    links = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return parts, links


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def semi_has_children(spark, sf_dir):
    return with_related(*_parts(spark, sf_dir), "p_partkey", True)


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def anti_no_children(spark, sf_dir):
    return with_related(*_parts(spark, sf_dir), "p_partkey", False)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand ILIKE '%3%' AND l_returnflag = 'R')")
def in_subquery_filter(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part").where(F.col("p_brand").ilike("%3%")), F.col("l_partkey") == F.col("p_partkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(hit.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("""SELECT p_partkey, p_name, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS degree FROM part ORDER BY degree DESC, p_partkey LIMIT 50""")
def degree_ranking(spark, sf_dir):
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("degree"))
    out = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(degree, "p_partkey", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
    return out.orderBy(F.desc("degree"), "p_partkey").limit(50)


@query("""SELECT event_id, event_type, coalesce(c_name, s_name) AS label, CASE WHEN c_name IS NOT NULL THEN 'customer' WHEN s_name IS NOT NULL THEN 'supplier' END AS kind FROM events
  LEFT JOIN customer ON event_type <> 'error' AND c_custkey = user_id LEFT JOIN supplier ON event_type = 'error' AND s_suppkey = user_id""")
def polymorphic_left_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    error = F.col("event_type") == "error"
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("as_customer"), "c_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("as_supplier"), "s_name")
    # Each kind meets its own table, so no nulls of the other kind gather in a task.
    out = ["event_id", "event_type"]
    as_customer = e.where(~error | error.isNull()).withColumnRenamed("user_id", "as_customer").join(c, "as_customer", "left").select(*out, F.when(~error, F.col("c_name")).alias("label"), F.lit("customer").alias("kind"))
    as_supplier = e.where(error).withColumnRenamed("user_id", "as_supplier").join(s, "as_supplier", "left").select(*out, F.col("s_name").alias("label"), F.lit("supplier").alias("kind"))
    return as_customer.unionByName(as_supplier).withColumn("kind", F.when(F.col("label").isNotNull(), F.col("kind")))


@query(f"SELECT * FROM (SELECT 'perm' AS program, case_status, count(*) AS n, sum(count(*)) OVER (PARTITION BY 1)::BIGINT AS total FROM ({PERM_SQL}) t GROUP BY case_status) ORDER BY 1, 2")
def outcome_shares(spark, sf_dir):
    found = perm(spark, sf_dir).groupBy("case_status").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    return found.join(F.broadcast(total)).select(F.lit("perm").alias("program"), "case_status", "n", "total")  # one row
