"""Source shapes laid over the driver's tables, read back by the readers of ``sources``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import bulletins, disclosure_files, dumps, search_pages, sheets, sinks
from ..sources.tables import spread, table
from .registry import query

BASE = "https://example.org"


def _of(kind: str, page: str = "c_nationkey * 100000 + c_custkey div 50") -> str:
    """One text per page of at most 50 customers."""
    return f"(SELECT {page} AS page, {kind} AS body FROM {{customer}} GROUP BY 1)"


_DOCKET = "printf('%04d-PER-%05d', 2000 + c_custkey % 25, c_custkey)"



@query(f"""SELECT c_name AS case_name, {_DOCKET} AS docket_number, make_date(2000 + c_custkey % 25, 1, 1 + c_custkey % 28)::VARCHAR AS decision_date, 'Case Decision' AS document_type,
  CASE WHEN c_custkey % 2 = 0 THEN '{BASE}/case/' || c_custkey END AS source_url, CASE WHEN c_custkey % 2 = 1 THEN '{BASE}/docs/' || c_custkey || '.pdf' END AS pdf_url, c_mktsegment || ' … ' || c_name AS snippet FROM customer""")
def search_response(spark, sf_dir):
    """JSON responses of a search service, each read into records."""
    doc = f"""named_struct('parsed_title', concat(c_name, ',  ', {_DOCKET}), 'file_path', if(c_custkey % 2 = 0, concat('/case/', c_custkey), concat('/docs/', c_custkey, '.pdf')),
      'issued_date', printf('%04d-01-%02d', 2000 + c_custkey % 25, 1 + c_custkey % 28), 'document_type', 'Case Decision', '@search.highlights', named_struct('content', array(c_mktsegment, c_name)))"""
    pages = spark.sql(_of(f"to_json(named_struct('value', collect_list({doc})))"), customer=table(spark, sf_dir, "customer"))
    found = search_pages.response_records(pages, "page", "body", BASE)
    return found.select("case_name", "docket_number", F.col("decision_date").cast("string"), "document_type", "source_url", "pdf_url", "snippet")


@query(f"""SELECT c_name || ', ' || {_DOCKET} AS case_name, {_DOCKET} AS docket_number, make_date(2000 + c_custkey % 25, 1, 1 + c_custkey % 28)::VARCHAR AS decision_date,
  '{BASE}/case/' || c_custkey AS source_url, CASE WHEN c_custkey % 3 > 0 THEN '{BASE}/docs/' || c_custkey || '.pdf' END AS pdf_url,
  'Decision issued Jan. ' || (1 + c_custkey % 28) || ', ' || (2000 + c_custkey % 25) AS snippet FROM customer""")
def search_results(spark, sf_dir):
    """Result pages of a search service, each read into records."""
    item = f"""concat('<article class="search-result"><h2><a href="/case/', c_custkey, '">', c_name, ', ', {_DOCKET}, '</a></h2><p>Decision issued Jan. ', 1 + c_custkey % 28, ', ', 2000 + c_custkey % 25, '</p>',
      if(c_custkey % 3 > 0, concat('<a href="/docs/', c_custkey, '.pdf">PDF</a>'), ''), '</article>')"""
    pages = spark.sql(_of(f"concat('<html><body><nav><a href=\"/\">Home</a></nav>', concat_ws('', collect_list({item})), '</body></html>')"), customer=table(spark, sf_dir, "customer"))
    return search_pages.result_records(pages, "page", "body", BASE).select("case_name", "docket_number", F.col("decision_date").cast("string"), "source_url", "pdf_url", "snippet")


def _bulletins(spark, sf_dir) -> DataFrame:
    row = "concat('<tr><td>', if(c_custkey % 2 = 0, '1st', 'Certain Religious Workers'), '</td><td>C</td><td>', printf('%02dJAN%02d', 1 + c_custkey % 28, c_custkey % 100), '</td><td>U</td></tr>')"
    head = "<tr><th>Employment-based</th><th>All Chargeability Areas Except Those Listed</th><th>CHINA-mainland born</th><th>Ruritania</th></tr>"
    body = f"concat('<div><h3>FINAL ACTION DATES FOR EMPLOYMENT-BASED PREFERENCE CASES</h3><table>{head}', {row}, '</table><p>Family-sponsored preference</p><table><tr><td>x</td></tr></table></div>')"
    pages = spark.sql(f"SELECT c_custkey AS page, {body} AS body FROM {{customer}}", customer=spread(table(spark, sf_dir, "customer").select("c_custkey")))
    return bulletins.bulletin_rows(pages, "page", "body")


_BULLETINS = """(SELECT c_custkey AS page, 'employment' AS category_type, 'final_action' AS date_type, CASE WHEN c_custkey % 2 = 0 THEN 'EB1' ELSE 'EB4R' END AS preference, chargeability,
  CASE chargeability WHEN 'CHINA' THEN make_date(CASE WHEN c_custkey % 100 < 50 THEN 2000 ELSE 1900 END + c_custkey % 100, 1, 1 + c_custkey % 28)::VARCHAR END AS priority_date,
  chargeability = 'ALL' AS is_current, chargeability = 'Ruritania' AS is_unavailable, CASE chargeability WHEN 'ALL' THEN 'C' WHEN 'CHINA' THEN printf('%02dJAN%02d', 1 + c_custkey % 28, c_custkey % 100) ELSE 'U' END AS raw_value
  FROM customer, (VALUES ('ALL'), ('CHINA'), ('Ruritania')) v(chargeability)) b"""


@query(f"SELECT page, category_type, date_type, preference, chargeability, priority_date, is_current, is_unavailable, raw_value FROM {_BULLETINS}")
def bulletin_cells(spark, sf_dir):
    """Priority-date tables below their headings, one row a cell."""
    return _bulletins(spark, sf_dir).withColumn("priority_date", F.col("priority_date").cast("string"))


@query(f"SELECT preference, count(DISTINCT raw_value) FILTER (WHERE chargeability = 'CHINA') AS china_cells, max(CASE WHEN chargeability = 'ALL' THEN raw_value END) AS all_cell FROM {_BULLETINS} GROUP BY 1")
def bulletin_summary(spark, sf_dir):
    b = _bulletins(spark, sf_dir)
    china, everywhere = F.when(F.col("chargeability") == "CHINA", F.col("raw_value")), F.when(F.col("chargeability") == "ALL", F.col("raw_value"))
    return b.groupBy("preference").agg(F.count_distinct(china).alias("china_cells"), F.max(everywhere).alias("all_cell"))


@query(f"""SELECT preference, "ALL", "CHINA" FROM (PIVOT (SELECT preference, chargeability, raw_value FROM {_BULLETINS} WHERE page IN (1, 2)) ON chargeability IN ('ALL', 'CHINA') USING first(raw_value) GROUP BY preference)""")
def bulletin_matrix(spark, sf_dir):
    """Preference by country for the bulletins of one month (here: of two pages, each of one preference)."""
    return bulletins.matrix(_bulletins(spark, sf_dir).where("page IN (1, 2)"), ["ALL", "CHINA"])


@query("""SELECT o_orderkey::VARCHAR AS case_number, o_orderstatus AS case_status, o_orderdate::DATE::VARCHAR AS received_date, CASE WHEN o_custkey % 3 = 0 THEN 'Old ' || o_custkey ELSE 'Legal ' || o_custkey END AS employer_name,
  o_totalprice AS pwd_wage_rate, o_orderpriority AS soc_code FROM orders WHERE o_orderkey % 10 <> 0""")
def program_headers(spark, sf_dir):
    """A wage file's own headers as target columns; blank case numbers go, fallbacks fill blank cells."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    raw = o.select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey").cast("string")).otherwise(" ").alias(" Case_Number "), F.concat(F.lit(" "), "o_orderstatus").alias("case_status"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("RECEIVED_DATE"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("Legal "), key)).otherwise("nan").alias("EMPLOYER_LEGAL_BUSINESS_NAME"), F.concat(F.lit("Old "), key).alias("EMPLOYER_NAME"),
        F.lit("").alias("PWD_WAGE_RATE"), F.col("o_totalprice").cast("string").alias("H2B_HIGHEST_PWD"), F.col("o_orderpriority").alias("SUGGESTED_SOC_CODE"))
    return disclosure_files.map_program(raw, "pw").select("case_number", "case_status", F.col("received_date").cast("string"), "employer_name", "pwd_wage_rate", "soc_code")


@query("""SELECT o_orderkey::VARCHAR AS case_number, o_orderdate::DATE::VARCHAR AS decision_date, 'Firm, ' || o_custkey AS employer_name, o_custkey::INT AS employer_num_payroll, o_totalprice AS wage_from, NULL::VARCHAR AS job_title FROM orders""")
def program_headers_perm(spark, sf_dir):
    """A certification file's headers; amounts with commas, whole numbers with a fraction, blank cells."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    raw = o.select(F.col("o_orderkey").cast("string").alias("case_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Decision_Date "), F.concat(F.lit("Firm, "), key).alias("EMP_BUSINESS_NAME"),
                   F.concat(key, F.lit(".0")).alias("EMP_NUM_PAYROLL"), F.col("o_totalprice").cast("string").alias("JOB_OPP_WAGE_FROM"), F.lit(" NaT ").alias("JOB_TITLE"))
    return disclosure_files.map_program(raw, "perm").select("case_number", F.col("decision_date").cast("string"), "employer_name", "employer_num_payroll", "wage_from", "job_title")


@query("""SELECT o_orderkey::VARCHAR AS case_number, 'H-1B' AS visa_class, o_orderdate::DATE::VARCHAR AS begin_date, CASE WHEN o_custkey % 2 = 0 THEN '11-' || o_custkey ELSE 'S' || o_custkey END AS worksite_state FROM orders WHERE o_orderkey % 7 <> 0""")
def program_headers_lca(spark, sf_dir):
    """A labor condition file's headers: of two that become equal the first counts."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    raw = o.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("string")).alias("CASE_NUMBER"), F.lit("H-1B").alias("visa_class"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("BEGIN_DATE"),
                   F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("11-"), key)).otherwise(F.concat(F.lit("S"), key)).alias("WORKSITE_STATE"), F.lit("second").alias(" worksite_state "))
    return disclosure_files.map_program(raw, "lca").select("case_number", "visa_class", F.col("begin_date").cast("string"), "worksite_state")


@query("""SELECT p_partkey::VARCHAR AS code, 'Title: ' || p_name || ' O''Neil' || coalesce(chr(10) || 'Also known as: ' || names, '') || chr(10) || 'Description: ' || p_type || coalesce(chr(10) || 'Key Tasks: ' || tasks, '') AS text FROM part
  LEFT JOIN (SELECT l_partkey, string_agg(m, ', ' ORDER BY first_seen) AS names FROM (SELECT l_partkey, 'Mode ' || l_linenumber AS m, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY 1, 2) GROUP BY 1) n ON n.l_partkey = p_partkey
  LEFT JOIN (SELECT l_partkey, string_agg('Ship ' || l_orderkey, ' ' ORDER BY seq) AS tasks FROM (SELECT l_partkey, l_orderkey, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS nth FROM lineitem WHERE l_returnflag = 'N') WHERE nth <= 10 GROUP BY 1) t ON t.l_partkey = p_partkey""")
def composite_occupations(spark, sf_dir):
    """Statements of a dump read into occupations, core tasks and other names, then composed."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("statement")
    code = F.col("l_partkey").cast("string")
    occupations = p.select(F.col("p_partkey").alias("seq"), say("INSERT INTO occupation_data (a, b, c) VALUES ('", F.col("p_partkey").cast("string"), "', '", F.col("p_name"), " O''Neil', '", F.col("p_type"), "'"))
    kind = F.when(F.col("l_returnflag") == "N", "Core").otherwise("Supplemental")
    tasks = li.select(seq, say("INSERT INTO task_statements (a, b, c, d) VALUES ('", code, "', 12.0, 'Ship ", F.col("l_orderkey").cast("string"), "', '", kind, "', NULL"))
    titles = li.select(seq, say("INSERT INTO alternate_titles (a, b) VALUES ('", code, "', 'Mode ", F.col("l_linenumber").cast("string"), "'"))
    return dumps.composite_texts(dumps.inserted(occupations, "occupation_data"), dumps.inserted(tasks, "task_statements"), dumps.inserted(titles, "alternate_titles"))


@query("""SELECT o_orderkey AS sheet_id, 'Report: Orders' || chr(10) || 'Sheet: S' || chr(10) || chr(10) || 'Order ' || o_orderkey || chr(10) || chr(10) || 'Line: 1 | Amount: ' || o_custkey || ' | Amount: ' || o_orderstatus || chr(10) || 'Line: 2 | Amount: ' || o_orderpriority AS text FROM orders""")
def sheet_blocks(spark, sf_dir):
    """Sheets with a title, a head with an empty cell, and rows with empty cells."""
    o, text = table(spark, sf_dir, "orders"), lambda c: F.col(c).cast("string")
    rows = F.array(
        F.array(F.concat(F.lit("Order "), text("o_orderkey")), F.lit(None), F.lit("nan"), F.lit("")), F.array(F.lit("Line"), F.lit("Amount"), F.lit(""), F.lit("Note")),
        F.array(F.lit("1"), text("o_custkey"), F.col("o_orderstatus"), F.lit(" ")), F.array(F.lit("2"), F.lit("None"), F.col("o_orderpriority"), F.lit(None)))
    cells = o.select(F.col("o_orderkey").alias("sheet_id"), F.lit("Orders").alias("label"), F.lit("S").alias("sheet"), F.posexplode(rows).alias("line", "cells"))
    return sheets.sheet_texts(cells)



@query(f"""SELECT user_id, CASE WHEN n.user_id IS NULL THEN o.kind ELSE n.kind END AS kind, coalesce(o.vector, n.vector) AS vector FROM
  (SELECT user_id, first(kind ORDER BY nth) AS kind, first(vector ORDER BY nth) AS vector FROM (SELECT user_id, event_type AS kind, value AS vector, -event_id AS nth FROM events WHERE event_id % 3 = 1) GROUP BY 1) n FULL JOIN
  (SELECT user_id, first(kind ORDER BY nth) AS kind, first(vector ORDER BY nth) AS vector FROM (SELECT user_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN value END AS vector, event_id AS nth FROM events WHERE event_id % 3 = 0) GROUP BY 1) o USING (user_id)""")
def upsert_keeps_vector(spark, sf_dir):
    """New rows overwrite all columns but a vector that is there."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("kind"), F.min_by(F.when(F.col("event_id") % 2 == 0, F.col("value")), "event_id").alias("vector"))
    new = e.where("event_id % 3 = 1").select("user_id", F.col("event_type").alias("kind"), F.col("value").alias("vector"), "event_id")
    return sinks.upsert_keeping(old, new, ["user_id"], [F.desc("event_id")], ["vector"])


@query("""SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, false AS is_total FROM orders GROUP BY 1 UNION ALL SELECT 'Grand Total', count(*), round(sum(o_totalprice), 2), true FROM orders""")
def export_with_total(spark, sf_dir):
    """The rows of a report and its total row, as they are exported."""
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return sinks.with_total(by, "priority", {"n": "sum", "total": "sum"}).withColumn("total", F.round("total", 2))


@query("""SELECT lang, count(*) AS sections, count(*) FILTER (WHERE length(text) > 0) AS with_text, coalesce(sum(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END), 0)::BIGINT AS words, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM documents GROUP BY 1""")
def corpus_statistics(spark, sf_dir):
    return sinks.corpus_statistics(table(spark, sf_dir, "documents"), "lang", "text")
