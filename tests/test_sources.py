"""Readers of source files and sinks, by literal cases."""

import datetime
import json

from pyspark.sql import functions as F

from ledgerloom.sources import bulletins, disclosure_files, dumps, search_pages, sheets, sinks

RESULT = """<main><div class="views-row"><h3><a href="decisions/77">In re Birch Mills, 2019-PER-00042</a></h3>
<p>Issued March 7, 2020</p><a href="https://files.example/birch.pdf">file</a></div><ul><li>nothing to follow</li></ul>
<ol><li class="usa-pagination__next"><a href="/list?page=5">more</a></li></ol></main>"""


def test_result_page(spark):
    pages = spark.createDataFrame([(1, RESULT), (2, None), (3, "")], "page int, html string")
    rows = search_pages.result_records(pages, "page", "html", "https://board.example").orderBy("page", "position").collect()
    first = rows[0]
    assert {r.page for r in rows} == {1}
    assert (first.docket_number, first.decision_date, first.pdf_url) == ("2019-PER-00042", datetime.date(2020, 3, 7), "https://files.example/birch.pdf")
    assert [r[0] for r in pages.orderBy("page").select(search_pages.next_page(F.col("html"), "https://board.example")).collect()] == ["https://board.example/list?page=5", None, None]


def test_response(spark):
    docs = [{"parsed_title": "Birch Mills - 2019-PER-042", "file_path": "/f/birch.pdf", "issued_date": "2020-03-07", "document_type": "Order"}, {"parsed_title": "", "file_path": "page/9"}, {"parsed_title": "Birch Mills - 2019-PER-042", "file_path": "/f/birch.pdf", "issued_date": "2020-03-07", "document_type": "Order"}]
    rows = search_pages.response_records(spark.createDataFrame([(1, json.dumps({"value": docs})), (2, "broken"), (3, None)], "k int, body string"), "k", "body", "https://board.example/").orderBy("position").collect()
    assert [(r.case_name, r.docket_number, r.pdf_url, r.source_url) for r in rows] == [("Birch Mills", "2019-PER-00042", "https://board.example/f/birch.pdf", None), ("", None, None, "https://board.example/page/9")]


def test_program_files(spark, tmp_path):
    folder = tmp_path / "FY2024_old"
    folder.mkdir()
    (folder / "a.csv").write_text('case_number , Emp_Business_Name,JOB_OPP_WAGE_FROM,DECISION_DATE,EMP_NUM_PAYROLL\nA-1," Acme, Inc. ","1,000",01/04/2025,12.9\n ,x,1,,\n', encoding="utf-8")
    (folder / "b.csv").write_text("JOB_OPP_WAGE_FROM,CASE_NUMBER\n7.5,A-2\n", encoding="utf-8")
    rows = disclosure_files.read_program(spark, [str(folder / "a.csv"), str(folder / "b.csv")], "perm").orderBy("case_number").collect()
    assert [(r.case_number, r.fiscal_year, r.source_file, r.employer_name, r.wage_from, r.decision_date, r.employer_num_payroll) for r in rows] == [
        ("A-1", "FY2024", "a.csv", "Acme, Inc.", None, datetime.date(2025, 1, 4), 12), ("A-2", "FY2024", "b.csv", None, 7.5, None, None)]
    assert disclosure_files.read_program(spark, [], "lca").count() == 0
    (folder / "c.csv").write_text('CASE_NUMBER,JOB_TITLE\nA-3,"two\nlines, ""quoted"""\nA-4,one\n', encoding="utf-8")
    rows = disclosure_files.read_program(spark, [str(folder / "c.csv")], "perm").orderBy("case_number").collect()
    assert [(r.case_number, r.job_title) for r in rows] == [("A-3", 'two\nlines, "quoted"'), ("A-4", "one")]
    index = spark.createDataFrame([(1, "a.pdf", " t "), (2, " a.pdf", "u"), (3, None, "v"), (4, "", "w")], "n int, pdf string, title string")
    assert [tuple(r) for r in disclosure_files.first_by_file(index, "pdf", [F.col("n")]).collect()] == [(1, "a.pdf", "t")]


def test_bulletin(spark):
    table = "<table><tr><th>Family</th><th>All Areas</th><th>Mexico *</th></tr><tr><td>2A*</td><td>{}</td><td>01JAN85</td></tr><tr><td>total</td><td>C</td><td>C</td></tr></table>"
    html = "<p>" + "x" * 130 + " final action employment based</p><h2>Final Action Dates, Family-Sponsored</h2><div>" + table.format("C") + table.format("02FEB2015") + "<table><tr><td>1</td><td>Mexico</td><td>India</td></tr><tr><td>1st</td><td>C</td><td>C</td></tr></table></div>"
    rows = bulletins.bulletin_rows(spark.createDataFrame([(1, html), (2, None)], "k int, html string"), "k", "html").orderBy("chargeability").collect()
    assert [(r.category_type, r.date_type, r.preference, r.chargeability, r.priority_date) for r in rows] == [
        ("family", "final_action", "F2A", "ALL", datetime.date(2015, 2, 2)), ("family", "final_action", "F2A", "MEXICO", datetime.date(1985, 1, 1))]
    labels = spark.createDataFrame([("5th Set Aside: Rural (20%)", "employment"), ("  Other   Workers* ", "employment"), ("F4", "family"), ("none", "family")], "raw string, category string")
    assert [r[0] for r in labels.select(bulletins.preference(F.col("raw"), F.col("category"))).collect()] == ["EB2", "EB3W", "F4", None]


def test_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO occupation_data (a,b,c) VALUES ('11-1', 'O''Neil', 'Line\none');\nINSERT INTO occupation_data (a,b,c) VALUES ('11-2', '', 'x');\n" + "".join(f"INSERT INTO alternate_titles (a,b) VALUES ('11-1', 't{i % 25}');\n" for i in range(60)), encoding="utf-8")
    rows = dumps.statements(spark, str(tmp_path / "d.sql"))
    occupations = dumps.inserted(rows, "occupation_data")
    assert [(r.code, r.title, r.description) for r in occupations.orderBy("code").collect()] == [("11-1", "O'Neil", "Line\none"), ("11-2", "", "x")]
    none = spark.createDataFrame([], "code string, task string, task_type string, seq int")
    texts = {r.code: r.text for r in dumps.composite_texts(occupations, none, dumps.inserted(rows, "alternate_titles")).collect()}
    assert texts == {"11-1": "Title: O'Neil\nAlso known as: " + ", ".join(f"t{i}" for i in range(20)) + "\nDescription: Line\none", "11-2": "Title: \nDescription: x"}


def test_sheet(spark):
    rows = [(1, "L", "S", 0, ["a", "b"]), (1, "L", "S", 1, ["c" * 50, None]), (2, "L", "S", 0, ["one row" * 20]), (3, "L", "S", 0, ["", "h", "", "k", "m"]), (3, "L", "S", 1, ["v", "w", "x", "nan", "y" * 50])]
    texts = {r.sheet_id: r.text for r in sheets.sheet_texts(spark.createDataFrame(rows, "sheet_id int, label string, sheet string, line int, cells array<string>")).collect()}
    assert texts == {1: "Report: L\nSheet: S\n\na | b\n" + "c" * 50, 3: "Report: L\nSheet: S\n\n\ncol0: v | h: w | h: x | m: " + "y" * 50}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 'say "x", y'), ("b", 3, None)], "k string, n int, t string")
    total = sinks.with_total(df, "k", {"n": "sum"}).orderBy("is_total", "k").collect()
    assert [tuple(r) for r in total] == [("a", 2, 'say "x", y', False), ("b", 3, None, False), ("Grand Total", 5, None, True)]
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"), [F.desc("n")], {"n": "N"})
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True, escape='"').collect()] == [("b", "3", None), ("a", "2", 'say "x", y')]
    assert df.sparkSession.read.csv(str(tmp_path / "out"), header=True).columns == ["k", "N", "t"]
