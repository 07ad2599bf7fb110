"""Stored index, ranked graphs, forms and letters, discovery, resumed merges and chunks over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import letters, manuals, wage_form
from ..functions.chunk import chunk_corpus, headed, heading_paths
from ..functions.citations import cite_key, resolve
from ..functions.extract import appeals_outcome, board_outcome, fiscal_year, stable_id
from ..functions.regulations import adopted_decision, chunk_citation, notice_tag, precedent_keys, regulation_file, section_index
from ..operators import graph as G
from ..operators import inverted_index as I
from ..operators import vector_index as V
from ..operators.filters import form_lookup, incremental, without_notices
from ..operators.resume import Target, merge, merged_crawl
from ..operators.search import highlight, parse_query, text_matches, text_score
from ..operators.series import forward_fill
from ..sources.disclosure_files import first_by_file
from ..sources.scratch import folder
from ..sources.site_links import statute_sections
from ..sources.tables import spread, table
from ..streaming.activity import once_over
from .registry import query

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

# --- stored index ---


def _documents_index(spark, sf_dir, stemmed: bool) -> I.Index:
    return I.build(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, folder(spark, "index"), stemmed=stemmed)


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'ntly')) AS a, len(list_filter(w, lambda x: x = 'ering')) AS b FROM d),
  s AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t),
  r AS (SELECT doc_id, round(ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 9) AS s FROM t, s WHERE a > 0 AND b > 0)
  SELECT doc_id, round(s, 6) AS score, (row_number() OVER (ORDER BY s DESC, doc_id))::INT AS rank FROM r ORDER BY s DESC, doc_id LIMIT 20""")
def index_search_top(spark, sf_dir):
    found = I.search(_documents_index(spark, sf_dir, False), "ntly ering", 20)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_TERM = "len(list_filter(w{f}, lambda x: x = '{t}'))"


def _field_sql(terms: tuple[str, ...]) -> str:
    counts = ", ".join(f"{_TERM.format(f=f, t=t)} AS c{f}_{t}" for f in (1, 2) for t in terms)
    stats = ", ".join(f"count(*) FILTER (WHERE c1_{t} + c2_{t} > 0) AS d_{t}" for t in terms)
    impact = lambda t: " + ".join(f"{w} * c{f}_{t} * 2.2 / (c{f}_{t} + 1.2 * (0.25 + 0.75 * n{f} / m{f}))" for f, w in ((1, 1.0), (2, 0.4)))
    score = " + ".join(f"ln(1 + (c - d_{t} + 0.5) / (d_{t} + 0.5)) * ({impact(t)})" for t in terms)
    return f"""WITH p AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w1, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS w2 FROM part), t AS (SELECT p_partkey, len(w1) AS n1, len(w2) AS n2, {counts} FROM p),
  s AS (SELECT count(*) AS c, avg(n1) AS m1, avg(n2) AS m2, {stats} FROM t) SELECT p_partkey, round(round({score}, 9), 6) AS score FROM t, s WHERE {" OR ".join(f"c1_{t} + c2_{t} > 0" for t in terms)}"""


@query(_field_sql(("ring", "economy", "small")))
def index_weighted_fields(spark, sf_dir):
    """All parts that hold a term in either field; a hit in the name counts for more."""
    index = I.build(table(spark, sf_dir, "part"), "p_partkey", {"p_name": 1.0, "p_type": 0.4}, folder(spark, "index"), stemmed=False)
    return I.matching(index, "ring OR economy OR small").select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


_GAP = "regexp_matches(lower(text), '(^|[^a-z0-9])ntre[^a-z0-9]+[a-z0-9]+[^a-z0-9]+onbleea([^a-z0-9]|$)')"


@query(f"SELECT doc_id FROM documents WHERE {_GAP}")
def index_phrase_gap(spark, sf_dir):
    """A phrase with a stop word, whose place any word may take, by positions of the index."""
    return I.matching(_documents_index(spark, sf_dir, False), '"ntre in onbleea"').select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM documents WHERE {_GAP}")
def docs_phrase_gap(spark, sf_dir):
    """The same within the scan."""
    return table(spark, sf_dir, "documents").where(text_matches(F.col("text"), parse_query('"ntre in onbleea"'))).select("doc_id")


@query()
def index_stemmed(spark, sf_dir):
    """By stems, which SQL has none of: "thinged" finds "thing" and "things"."""
    return I.search(_documents_index(spark, sf_dir, True), "thinged OR ntlying", 50).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(r"""SELECT doc_id, regexp_replace(text, '(ering|ntly)', '<mark>\1</mark>', 'gi') AS text FROM documents WHERE doc_id % 10 = 3 AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'ering')""")
def docs_highlighted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(text_matches(F.col("text"), parse_query("ering")))
    return docs.where("doc_id % 10 = 3").select("doc_id", highlight(F.col("text"), "ering of ntly").alias("text"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
  SELECT id, (SELECT count(*) FROM lineitem WHERE l_orderkey = id) AS regulation_count, (SELECT count(*) FROM lineitem WHERE l_suppkey = id) AS citation_count,
  (SELECT count(*) FROM lineitem WHERE l_partkey = id) AS cited_by_count, (SELECT count(*) FROM lineitem WHERE l_suppkey = id AND l_returnflag = 'N') AS unresolved_count FROM f""")
def hit_enrichment(spark, sf_dir):
    """Counts beside each hit of a page: the related tables are cut to the page's keys before they are counted."""
    page = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem")
    for name, key, only in (("regulation_count", "l_orderkey", None), ("citation_count", "l_suppkey", None), ("cited_by_count", "l_partkey", None), ("unresolved_count", "l_suppkey", "l_returnflag = 'N'")):
        rows = lines if only is None else lines.where(only)
        n = rows.join(F.broadcast(page.select(F.col("id").alias(key))), key, "left_semi").groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))  # twenty keys
        page = page.join(n, "id", "left").fillna(0, [name])
    return page


# --- graphs ---

_E = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
_IN = f"(SELECT dst AS id, count(DISTINCT src) AS degree FROM {_E} GROUP BY 1)"
_SEEDS = f"""e AS {_E}, seeds AS (SELECT o.id, round(0.7 * ln(2) + 0.3 * log10(1 + coalesce(d.degree, 0)), 9) AS rank FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' {{only}}) o LEFT JOIN {_IN} d ON d.id = o.id ORDER BY rank DESC, o.id LIMIT 40),
  out AS (SELECT * FROM e WHERE src IN (SELECT id FROM seeds)), deg AS (SELECT dst AS id, count(*) AS degree FROM out WHERE dst NOT IN (SELECT id FROM seeds) GROUP BY 1)"""
_RANKED = f"""WITH {_SEEDS.format(only="")}, kept AS (SELECT id, degree FROM deg WHERE degree >= 2 OR (SELECT count(*) FROM deg WHERE degree >= 2) < 3 ORDER BY degree DESC, id LIMIT 30),
  nodes AS (SELECT id, 'primary' AS tier, round(rank, 6) AS rank, 0::BIGINT AS degree FROM seeds UNION ALL SELECT id, 'secondary', 0, degree FROM kept)"""
_MIXED = f"""WITH prec AS (SELECT p_partkey AS id FROM part WHERE p_size <= 5), {_SEEDS.format(only="AND o_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 5)")},
  named AS (SELECT d.*, CASE WHEN d.id IN (SELECT id FROM prec) THEN 'precedent' ELSE 'other' END AS kind FROM deg d),
  kept AS (SELECT id, degree, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS nth FROM named WHERE kind = 'precedent' OR degree >= 2 OR (SELECT count(*) FROM named WHERE kind = 'other' AND degree >= 2) < 3) WHERE nth <= CASE kind WHEN 'precedent' THEN 20 ELSE 15 END),
  nodes AS (SELECT id, 'primary' AS tier, round(rank, 6) AS rank, 0::BIGINT AS degree, CASE WHEN id IN (SELECT p_partkey FROM part) THEN 'other' END AS kind FROM seeds UNION ALL SELECT id, 'secondary', 0, degree, kind FROM kept)"""


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def _ranked_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q, edges = parse_query("urgent"), _edges(spark, sf_dir)
    found = table(spark, sf_dir, "orders").where(text_matches(F.col("o_orderpriority"), q)).select(F.col("o_orderkey").alias("id"), text_score(F.col("o_orderpriority"), q).alias("score"))
    return G.around(edges, G.seeds_of(found, edges))


def _mixed_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q, edges = parse_query("urgent"), _edges(spark, sf_dir)
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 5, "precedent").otherwise("other").alias("kind"))
    found = table(spark, sf_dir, "orders").where(text_matches(F.col("o_orderpriority"), q)).select(F.col("o_orderkey").alias("id"), text_score(F.col("o_orderpriority"), q).alias("score"))
    found = found.join(kinds.where("kind = 'precedent'"), "id", "left_anti")
    return G.around(edges, G.seeds_of(found, edges), kinds, {"precedent": 20, "other": 15}, always=("precedent",))


@query(f"{_RANKED} SELECT id, tier, rank, degree FROM nodes")
def graph_ranked_nodes(spark, sf_dir):
    return _ranked_graph(spark, sf_dir)[0].select("id", "tier", F.round("rank", 6).alias("rank"), "degree")


@query(f"{_RANKED} SELECT src, dst FROM out WHERE dst IN (SELECT id FROM nodes)")
def graph_ranked_edges(spark, sf_dir):
    return _ranked_graph(spark, sf_dir)[1]


@query(f"{_MIXED} SELECT id, kind, tier, rank, degree FROM nodes")
def graph_mixed_nodes(spark, sf_dir):
    return _mixed_graph(spark, sf_dir)[0].select("id", "kind", "tier", F.round("rank", 6).alias("rank"), "degree")


@query(f"{_MIXED} SELECT src, dst FROM out WHERE dst IN (SELECT id FROM nodes)")
def graph_mixed_edges(spark, sf_dir):
    return _mixed_graph(spark, sf_dir)[1]


@query(f"""WITH e AS {_E}, hubs AS (SELECT p_partkey AS id FROM part WHERE p_name ILIKE '%ring%' AND p_size <= 3), cites AS (SELECT src AS id, count(*) AS degree FROM e WHERE dst IN (SELECT id FROM hubs) GROUP BY 1),
  citing AS (SELECT c.id, c.degree FROM cites c LEFT JOIN {_IN} d ON d.id = c.id LEFT JOIN orders o ON o.o_orderkey = c.id ORDER BY c.degree DESC, coalesce(d.degree, 0) DESC, o.o_orderdate DESC NULLS LAST, c.id LIMIT 40),
  beside AS (SELECT dst AS id, count(*) AS degree FROM e WHERE src IN (SELECT id FROM citing) AND dst NOT IN (SELECT id FROM hubs) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
  SELECT id, 'hub' AS tier, 0::BIGINT AS degree FROM hubs UNION ALL SELECT id, 'citing', degree FROM citing UNION ALL SELECT id, 'sibling', degree FROM beside""")
def graph_around_hub(spark, sf_dir):
    hubs = table(spark, sf_dir, "part").where("p_name ILIKE '%ring%' AND p_size <= 3").select(F.col("p_partkey").alias("id"))
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"))
    return G.around_hub(_edges(spark, sf_dir), hubs, dates)[0]


@query(f"""WITH n AS (SELECT p_partkey AS id FROM part WHERE p_size = 7), e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem), d AS (SELECT n.id, count(e.dst) AS in_degree FROM n LEFT JOIN e ON e.dst = n.id GROUP BY 1)
  SELECT id, in_degree, round(10 + 28.0 * in_degree / greatest((SELECT max(in_degree) FROM d), 1), 6) AS radius FROM d""")
def graph_drawn_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("id"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.drawn(nodes, edges)[0].select("id", "in_degree", F.round("radius", 6).alias("radius"))


# --- forms, letters, manuals ---


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS layout, 'Clerk ' || o_custkey AS job_title, 'Boise' AS city, 'ID' AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS travel,
  'Does task ' || o_orderkey || '.' AS duties, CASE o_orderkey % 3 WHEN 0 THEN 'Bachelor''s' WHEN 1 THEN 'Master''s' ELSE 'None' END AS degree, '$' || format('{:,}', 50000 + o_custkey) || ' / ' || CASE WHEN o_orderkey % 5 = 0 THEN 'Month' ELSE 'Year' END AS wage FROM orders""")
def wage_forms(spark, sf_dir):
    """Forms of both layouts laid over orders, long answers of every second one in an addendum."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).withColumn("new", F.col("o_orderkey") % 2 == 0)
    key, wage = F.col("o_orderkey").cast("string"), (50000 + F.col("o_custkey")).cast("string")
    box = lambda on, label: _text(F.when(on, "☒ ").otherwise("☐ "), label)
    goes, unit = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 == 0
    title = _text("1. Job title *\nClerk ", F.col("o_custkey").cast("string"), "\n")
    travel = _text(" Will travel be required?\n", box(goes, "Yes "), box(~goes, "No"), "\n")
    school = _text("1. Education: ", box(F.col("o_orderkey") % 3 == 2, "None "), box(F.col("o_orderkey") % 3 == 0, "Bachelor "), box(F.col("o_orderkey") % 3 == 1, "Master "), "\n2. Does the employer require a second\n")
    new = F.array(
        F.lit("cover"), _text(title, "2. Job duties *\nPlease see addendum\nForm ETA-9141\n"), school, _text("3.", travel, "3. City *  4. State *  5. County *\nBoise  ID  Ada\n"),
        _text("G. Prevailing Wage\n4. Prevailing wage\n $ ", wage, " . 00\na. Per:\n", box(unit, "Month "), box(~unit, "Year")), _text("Addendum for Section F.a.2: Job Duties\nDoes task ", key, ".\nPage 6"),
    )
    old = F.array(F.lit("cover"), _text(title, "5. Job duties: begin in this space. *\nDoes task ", key, ".\n6.", travel, school), F.lit("3. City *\nBoise\n4. State *\nID\n"), _text("4. Prevailing wage $ ", wage, "\n5. Per:\n", box(unit, "Month "), box(~unit, "Year")))
    return o.select("o_orderkey", F.when(F.col("new"), new).otherwise(old).alias("pages")).select("o_orderkey", wage_form.fields(F.col("pages")).alias("f")).select("o_orderkey", "f.*").drop("skills")


def _spans(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("who"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("start"), F.to_date(F.add_months(F.date_trunc("month", "o_orderdate"), (F.col("o_orderkey") % 30).cast("int"))).alias("end"))


@query("""SELECT o_orderkey, 'Board ' || o_custkey AS employer, 'Ann Bell' AS beneficiary, 'Clerk' AS job_title, date_trunc('month', o_orderdate)::DATE::VARCHAR AS start_month, (date_trunc('month', o_orderdate) + to_months((o_orderkey % 30)::INT))::DATE::VARCHAR AS end_month,
  (o_orderkey % 30)::INT AS months, CASE WHEN o_orderkey % 2 = 0 THEN 'Java,Python' ELSE 'SQL' END AS skills FROM orders""")
def experience_letters(spark, sf_dir):
    """Letters laid over orders, read back."""
    rows = spread(_spans(spark, sf_dir))
    said = _text("Board ", F.col("who").cast("string"), "\n\nThis is to certify that work was done here.\nWe employed Ann Bell as a Clerk, from ", F.date_format("start", "MMMM d, yyyy"), " to ", F.date_format("end", "MM/yyyy"), ".\nDuties:\nUsed ", F.when(F.col("o_orderkey") % 2 == 0, "Python and Java").otherwise("SQL"), " daily.\nSincerely,\n")
    f = rows.select("o_orderkey", letters.fields(said, F.lit("2000-01-01").cast("date")).alias("f")).select("o_orderkey", "f.*")
    return f.select("o_orderkey", "employer", "beneficiary", "job_title", F.col("span.start").cast("string").alias("start_month"), F.col("span.end").cast("string").alias("end_month"), F.col("span.months").alias("months"), F.array_join("skills", ",").alias("skills"))


@query("""WITH r AS (SELECT o_custkey AS who, date_trunc('month', o_orderdate)::DATE AS s, (date_trunc('month', o_orderdate) + to_months((o_orderkey % 30)::INT))::DATE AS e FROM orders),
  b AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY who ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM r),
  i AS (SELECT *, sum(begins) OVER (PARTITION BY who ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b), m AS (SELECT who, island, min(s) AS s, max(e) AS e, count(*) AS jobs FROM i GROUP BY 1, 2)
  SELECT who, sum(jobs)::BIGINT AS jobs, sum(date_diff('month', s, e))::BIGINT AS months, min(s)::VARCHAR AS first_month, max(e)::VARCHAR AS last_month FROM m GROUP BY 1""")
def experience_months(spark, sf_dir):
    """Months of each person, in several jobs at once counted once."""
    out = letters.months_of_experience(_spans(spark, sf_dir), "who")
    return out.select("who", "jobs", "months", F.col("first").cast("string").alias("first_month"), F.col("last").cast("string").alias("last_month"))


@query()
def manual_sections(spark, sf_dir):
    """Manuals of pages laid over orders: customers are files, a label stands on the pages of urgent and low orders."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("file"), F.col("o_orderkey").alias("page"), "o_orderpriority")
    head = F.when(F.col("o_orderpriority").startswith("1"), _text("Volume ", (F.col("page") % 3 + 1).cast("string"), ", Part ", F.when(F.col("page") % 2 == 0, "A").otherwise("B"), " – Subject ", (F.col("page") % 2).cast("string"), "\n")).otherwise("")
    return manuals.split_manual(o.select("file", "page", F.concat(head, F.lit("text of "), F.col("page").cast("string")).alias("text")))


@query("""SELECT p_partkey, '8 FAM ' || p_size || '.1' AS section, 'Visa-Work Of ' || upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) AS subject FROM part""")
def policy_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _text("8 FAM ", F.col("p_size").cast("string"), ".1 visa-work of ", F.substring_index("p_name", " ", 1), ".pdf").alias("name"))
    return p.select("p_partkey", manuals.policy_name(F.col("name")).alias("f")).select("p_partkey", "f.section", "f.subject")


# --- discovery, merges, chunks, vectors, activity ---


@query("""SELECT s_suppkey::VARCHAR AS section, s_name AS title, 'https://law.example/uscode/text/8/' || s_suppkey AS url FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region))""")
def statute_discovery(spark, sf_dir):
    """Sections found from an index page through parts of parts: regions list nations, nations list suppliers; one link leads back, one nowhere."""
    site, part = "https://law.example", "/uscode/text/8/chapter-12/subchapter-II/part-"
    item = lambda href, label: _text("<li><a href='", href, "'>", label, "</a></li>")

    def page(rows: DataFrame, url: Column, link: Column) -> DataFrame:
        return rows.groupBy(url.alias("url")).agg(F.concat(F.lit("<main><ul>"), F.array_join(F.array_sort(F.collect_list(link)), ""), F.lit("</ul></main>")).alias("html"))

    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    pages = [
        page(region, F.lit(f"{site}/index"), item(_text(part, "R", F.col("r_regionkey").cast("string")), F.col("r_name"))),
        page(nation, _text(site + part, "R", F.col("n_regionkey").cast("string")), _text(item(_text(part, "N", F.col("n_nationkey").cast("string")), F.col("n_name")), f"<li><a href='{part}R0'>back</a></li><li><a href='{part}gone'>gone</a></li>")),
        page(supplier, _text(site + part, "N", F.col("s_nationkey").cast("string")), item(_text("/uscode/text/8/", F.col("s_suppkey").cast("string")), _text("§ ", F.col("s_suppkey").cast("string"), ". ", F.col("s_name")))),
    ]
    start = region.select(F.lit(f"{site}/index").alias("url")).distinct()
    return statute_sections(reduce(DataFrame.unionByName, pages), start).select("section", "title", "url")


@query("SELECT o_orderkey, upper(o_orderpriority) || '/' || o_orderstatus AS made FROM orders")
def resumed_batches(spark, sf_dir):
    """Orders made batch by batch in two runs, the first of which stops after one batch."""
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    target = Target(spark, folder(spark, "resumed"), "o_orderkey bigint, made string", "o_orderkey")
    make = lambda rows: rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.concat_ws("/", F.upper("o_orderpriority"), "o_orderstatus").alias("made"))
    merge(target, source, "o_orderstatus", make, "first", ["F"])
    merge(target, source, "o_orderstatus", make, "second")
    return target.rows()


@query("""SELECT o_orderkey, o_orderpriority, age FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderkey ORDER BY age) AS nth FROM (
  SELECT o_orderkey, o_orderpriority, 'new' AS age FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderpriority, 'old' FROM orders WHERE o_orderkey % 2 = 0)) WHERE nth = 1""")
def crawl_merged(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    groups = o.select("o_orderpriority").distinct().withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("int"))
    found = merged_crawl(o.where("o_orderkey % 3 = 0").withColumn("age", F.lit("new")), o.where("o_orderkey % 2 = 0").withColumn("age", F.lit("old")), groups, "o_orderpriority", "o_orderkey", "o_orderkey")
    return found.select("o_orderkey", "o_orderpriority", "age")


@query("""WITH l AS (SELECT o_custkey AS file, o_orderkey AS place, CASE WHEN o_orderkey % 9 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 4 = 0 THEN 3 END AS lv FROM orders),
  a AS (SELECT *, max(place) FILTER (lv = 1) OVER w AS a1, max(place) FILTER (lv = 2) OVER w AS a2, max(place) FILTER (lv = 3) OVER w AS a3 FROM l WINDOW w AS (PARTITION BY file ORDER BY place ROWS UNBOUNDED PRECEDING))
  SELECT file, place, concat_ws(' > ', 'T' || a1, CASE WHEN a2 > coalesce(a1, -1) THEN 'T' || a2 END, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN 'T' || a3 END) AS path FROM a""")
def chunk_heading_paths(spark, sf_dir):
    key = F.col("o_orderkey")
    level = F.when(key % 9 == 0, 1).when(key % 5 == 0, 2).when(key % 4 == 0, 3)
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), key.alias("place"), level.alias("lv"), _text("T", key.cast("string")).alias("title"))
    return heading_paths(lines, "file", "place", "lv", "title", 3).select("file", "place", F.array_join("path", " > ").alias("path"))


@query()
def chunk_corpora(spark, sf_dir):
    """Documents and sections in one table of chunks, each with its label and what its corpus carries along."""
    docs = chunk_corpus(table(spark, sf_dir, "documents"), "documents", "doc_id", "text", label=F.concat_ws("/", "lang", "source"), carried={"cfr_citation": F.lit(None).cast("string"), "form_type": F.col("source")}, target=200)
    b = table(spark, sf_dir, "benchmark")
    label, text = headed(F.col("item_id").cast("string"), F.lit("Benchmark"), F.col("text"))
    sections = chunk_corpus(b.withColumn("headed", text), "benchmark", "item_id", "headed", label=label, carried={"cfr_citation": _text("8 USC ", F.col("item_id").cast("string")), "form_type": F.lit(None).cast("string")})
    return docs.unionByName(sections)


def _lists(spark, sf_dir) -> V.Lists:
    return V.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", folder(spark, "lists"), lists=24)


@query("""SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS similarity
  FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY similarity DESC, e.vec_id LIMIT 20""")
def vector_lists_exact(spark, sf_dir):
    """All lists probed: the exact way of the index."""
    asked = list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])
    return V.nearest(_lists(spark, sf_dir), asked, 20, probe=24).withColumnRenamed("id", "vec_id")


@query()
def vector_lists_recall(spark, sf_dir):
    """Recall of probing against all rows, for every hundredth vector as query."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.recall(_lists(spark, sf_dir), asked, 10, probe=16).select(F.col("query").alias("vec_id"), F.round("recall", 4).alias("recall"))


@query("SELECT event_type AS key, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS empty, round(avg(value), 6) AS mean, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def activity_replayed(spark, sf_dir):
    """Loads that overlap: every event comes twice and counts once."""
    e = table(spark, sf_dir, "events")
    out = once_over(e.unionByName(e), "event_type", "event_id", "ts", "value")
    return out.select("key", "n", "empty", F.round("mean", 6).alias("mean"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


# --- readers' fields and lookups over laid texts ---


@query("SELECT o_orderkey, 'FY' || year(o_orderdate) AS fiscal_year FROM orders")
def path_fiscal_year(spark, sf_dir):
    path = _text("/data/perm/FY", F.year("o_orderdate").cast("string"), "_Q4/PERM_", F.col("o_orderkey").cast("string"), ".csv")
    return table(spark, sf_dir, "orders").select("o_orderkey", fiscal_year(path).alias("fiscal_year"))


@query("SELECT o_orderpriority AS name, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def index_first_by_file(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(_text("  ", F.col("o_orderpriority"), " ").alias("name"), "o_orderkey")
    return first_by_file(rows, "name", [F.col("o_orderkey")])


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 8 WHEN 1 THEN 20 ELSE 22 END AS cfr_title, CASE p_size % 3 WHEN 0 THEN '214' WHEN 1 THEN '656' ELSE '41' END AS cfr_part, CASE p_size % 3 WHEN 0 THEN 'DHS / USCIS' WHEN 1 THEN 'DOL / ETA' ELSE 'State Department' END AS agency,
  CASE p_size % 3 WHEN 0 THEN 'Nonimmigrant Classes' WHEN 1 THEN 'PERM Labor Certification' ELSE 'Visas: Nonimmigrant Visas' END AS part_name, '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS as_of FROM part""")
def regulation_files(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    which = F.col("p_size") % 3
    name = _text(F.when(which == 0, "8 CFR Part 214").when(which == 1, "20 CFR Part 656").otherwise("22 CFR Part 41"), " up to date as of 1-", (F.col("p_size") % 28 + 1).cast("string"), "-2024.pdf")
    f = part.select("p_partkey", regulation_file(name).alias("f")).select("p_partkey", "f.*")
    return f.select("p_partkey", "cfr_title", "cfr_part", "agency", "part_name", F.col("as_of_date").cast("string").alias("as_of"))


@query("SELECT p_partkey, '214.' || p_size AS section, p_name AS title FROM part")
def regulation_sections(spark, sf_dir):
    """The section index: of a section that a text names twice the first title stays."""
    text = _text("intro\n§ 214.", F.col("p_size").cast("string"), " ", F.col("p_name"), "\nbody\n§ 214.", F.col("p_size").cast("string"), " again\n")
    return section_index(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text").select("p_partkey", "section", "title")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '8 CFR 214.' || o_orderkey % 7 ELSE '8 CFR Part 214' END AS cfr_citation FROM orders")
def chunk_citations(spark, sf_dir):
    chunk = F.when(F.col("o_orderkey") % 2 == 0, _text("under § 214.", (F.col("o_orderkey") % 7).cast("string"), " a petition")).otherwise("no section here")
    return table(spark, sf_dir, "orders").select("o_orderkey", chunk_citation(chunk, F.lit(8), F.lit("8 CFR Part 214")).alias("cfr_citation"))


@query("SELECT s_suppkey, 'S-' || s_suppkey || ' Inc' AS party_name, '2020-' || s_suppkey AS adopted_num, 2020 AS year, 'Adopted 2020-' || s_suppkey AS citation FROM supplier")
def adopted_decisions(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    head = _text("U.S. Citizenship\nMarch 3, 2020\nPM-602-0171\nSUBJECT: Matter of S-", key, " Inc, Adopted Decision 2020-", key, " (AAO Mar. 3, 2020)\n")
    f = table(spark, sf_dir, "supplier").select("s_suppkey", adopted_decision(head, F.lit("file")).alias("f")).select("s_suppkey", "f.*")
    return f.select("s_suppkey", "party_name", "adopted_num", "year", "citation")


@query("SELECT p_partkey FROM part WHERE 'I-' || p_size = 'I-14' OR p_name ILIKE 'I-14%' OR p_brand || p_name ILIKE 'i-14%'")
def form_number_lookup(spark, sf_dir):
    form = _text("I-", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").where(form_lookup("i-14", form, F.col("p_name"), F.concat("p_brand", "p_name"))).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderdate >= DATE '1995-01-01'")
def incremental_orders(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental(table(spark, sf_dir, "orders"), done, "o_orderkey", F.col("o_orderdate") >= F.lit("1995-01-01").cast("date")).select("o_orderkey")


@query("""SELECT tag, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'docketing_notice' WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'decision' END AS tag FROM orders) WHERE tag <> 'docketing_notice' GROUP BY 1""")
def decisions_without_notices(spark, sf_dir):
    """Tagged notices, and documents without a type, drop out of a default search."""
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, "Notice of Docketing, Briefing Schedule").otherwise("Decision")
    kind = F.when((F.col("o_orderkey") % 9 == 0) & ~((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0)), F.lit(None)).otherwise("decision")
    tagged = o.select(notice_tag(kind, F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), text).alias("tag"))
    return tagged.where(without_notices(F.col("tag"))).groupBy("tag").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS priority FROM orders""")
def forward_filled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority"))
    return forward_fill(o, ["o_custkey"], ["o_orderkey"], "priority")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Sustained' WHEN 1 THEN 'Dismissed' WHEN 2 THEN 'Remanded' WHEN 3 THEN 'Withdrawn' END AS appeals, CASE o_orderkey % 5 WHEN 0 THEN 'Reversed' WHEN 1 THEN 'Dismissed' WHEN 2 THEN 'Remanded' WHEN 3 THEN 'Affirmed' ELSE 'Unknown' END AS board FROM orders""")
def decision_outcomes(spark, sf_dir):
    which = F.col("o_orderkey") % 5
    appeals = _text("The appeal will be ", F.when(which == 0, "sustained").when(which == 1, "dismissed").when(which == 2, "remanded").when(which == 3, "withdrawn").otherwise("heard"), ".")
    board = F.when(which == 0, "certification is GRANTED").when(which == 1, "is HEREBYDISMISSED").when(which == 2, "VACATED and the case is REMANDED").when(which == 3, "denial is AFFIRMED").otherwise("so ordered")
    return table(spark, sf_dir, "orders").select("o_orderkey", appeals_outcome(appeals).alias("appeals"), board_outcome(board).alias("board"))


@query("""SELECT p_partkey, key FROM (SELECT p_partkey, unnest(['2' || p_size || ' I&N Dec. ' || p_partkey, '2' || p_size || ' l&N Dec. ' || p_partkey] || CASE WHEN p_size % 2 = 0 THEN ['Adopted Decision 2020-' || p_partkey, 'Adopted' || chr(160) || 'Decision' || chr(160) || '2020-' || p_partkey] ELSE []::VARCHAR[] END) AS key FROM part)""")
def precedent_lookup_keys(spark, sf_dir):
    cite = _text("2", F.col("p_size").cast("string"), " I&N Dec. ", F.col("p_partkey").cast("string"))
    keys = precedent_keys(cite, F.when(F.col("p_size") % 2 == 0, "adopted").otherwise("board"), _text("2020-", F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(keys).alias("key"))


@query("""SELECT l_orderkey AS citing_id, '2019-PER-' || l_partkey AS cited_raw, max(p_partkey) AS resolved_id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE l_linenumber = 1 GROUP BY ALL""")
def citations_resolved(spark, sf_dir):
    """Citations against known keys, docket numbers filled to five digits on both sides."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("citing_id"), F.lit("board").alias("citation_type"), _text("2019-PER-", F.col("l_partkey").cast("string")).alias("cited_raw")).distinct()
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.lit("board").alias("citation_type"), cite_key(_text("2019-per-", F.col("p_partkey").cast("string")), True).alias("key"), F.col("p_partkey").alias("id"))
    return resolve(lines, known, canonical=True).select("citing_id", "cited_raw", "resolved_id")


@query("""SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'D' || o_orderkey || '::decision::' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'url::u' || o_orderkey END AS id FROM orders)""")
def stable_ids(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    made = stable_id(F.when(F.col("o_orderkey") % 3 == 0, _text("D", key)), F.lit("decision"), F.to_date("o_orderdate"), _text("u", key), key)
    return o.select(made.alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("""SELECT p_type AS category, count(*) AS n, (round(count(*) * 100.0 / (SELECT count(*) FROM part)))::BIGINT AS share FROM (SELECT CASE WHEN p_size = 1 THEN 'Uncategorized' ELSE p_type END AS p_type FROM part) GROUP BY 1""")
def category_shares(spark, sf_dir):
    """Rows without a category under a name of their own, which sorts last; shares in whole per cent."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") != 1, F.col("p_type")).alias("category"))
    total = p.agg(F.count("*").alias("all"))
    out = p.groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row
    out = out.select(F.coalesce("category", F.lit("Uncategorized")).alias("category"), "n", F.round(F.col("n") * 100 / F.col("all")).cast("bigint").alias("share"), F.col("category").isNull().alias("last"))
    return out.orderBy("last", "category").drop("last")


@query("""SELECT corpus, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT 'orders' AS corpus, o_orderkey AS id FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'parts', p_partkey FROM part WHERE p_partkey % 97 = 0) GROUP BY 1""")
def hits_by_corpus(spark, sf_dir):
    """A page of hits, at most a few hundred, listed by corpus."""
    hits = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").select(F.lit("orders").alias("corpus"), F.col("o_orderkey").alias("id"))
    hits = hits.unionByName(table(spark, sf_dir, "part").where("p_partkey % 97 = 0").select(F.lit("parts").alias("corpus"), F.col("p_partkey").alias("id")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return hits.groupBy("corpus").agg(F.count("*").alias("n"), ids.alias("ids"))


@query("""SELECT o_custkey, coalesce(sum((o_orderkey % 30)) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT AS saved_months, count(*) FILTER (WHERE o_orderstatus = 'F') AS saved FROM orders GROUP BY 1""")
def saved_months(spark, sf_dir):
    saved = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.when(saved, F.col("o_orderkey") % 30).otherwise(0)).alias("saved_months"), F.count_if(saved).alias("saved"))


@query("""SELECT min(name) AS name FROM (SELECT c_name AS name FROM customer WHERE c_custkey = 5 UNION ALL SELECT s_name FROM supplier WHERE s_suppkey = 5)""")
def name_lookup(spark, sf_dir):
    """One name of a key that several tables may know; the least, so that it is always the same."""
    named = table(spark, sf_dir, "customer").where("c_custkey = 5").select(F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").where("s_suppkey = 5").select(F.col("s_name").alias("name")))
    return named.agg(F.min("name").alias("name"))


@query("""SELECT bulletin, n FROM (SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS bulletin, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24) ORDER BY 1""")
def last_months(spark, sf_dir):
    """The last 24 months, oldest first, as a bar chart shows them."""
    months = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).cast("string").alias("bulletin")).agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("bulletin")).limit(24).orderBy("bulletin")


@query("""SELECT e.l_orderkey, e.l_linenumber, coalesce(p.p_name, s.s_name, c.c_name) AS cited FROM lineitem e LEFT JOIN part p ON p.p_partkey = e.l_partkey AND p.p_size > 25 LEFT JOIN supplier s ON s.s_suppkey = e.l_suppkey AND s.s_acctbal > 5000 LEFT JOIN customer c ON c.c_custkey = e.l_suppkey WHERE e.l_orderkey % 10 = 0""")
def cited_in_three_tables(spark, sf_dir):
    """Each edge against three tables, the first that knows it names it."""
    e = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = e.join(table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    e = e.join(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    e = e.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l_suppkey"), "c_name"), "l_suppkey", "left")
    return e.select("l_orderkey", "l_linenumber", F.coalesce("p_name", "s_name", "c_name").alias("cited"))


@query("""SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'needs_review' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'ok' ELSE 'none' END AS quality FROM orders""")
def citation_quality(spark, sf_dir):
    """A state from what related rows there are; these are summed once before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    quality = F.when(F.col("returned"), "needs_review").when(F.col("returned").isNotNull(), "ok").otherwise("none")
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", quality.alias("quality"))


@query("""SELECT corpus, id, tag, round(score, 6) AS score FROM (SELECT 'documents' AS corpus, doc_id AS id, lang AS tag, 0.55 * ln(1 + n) AS score FROM (SELECT doc_id, lang, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'ering')) AS n FROM documents) WHERE n > 0
  UNION ALL SELECT 'benchmark', item_id, NULL, 0.65 * ln(1 + n) FROM (SELECT item_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'ering')) AS n FROM benchmark) WHERE n > 0
  UNION ALL SELECT 'conversations', conv_id, role, ln(1 + n) FROM (SELECT conv_id, role, turn, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'ering')) AS n FROM conversations) WHERE n > 0
  UNION ALL SELECT 'parts', p_partkey, p_brand, 2.0 FROM part WHERE p_name ILIKE '%ring%' UNION ALL SELECT 'suppliers', s_suppkey, NULL, 1.0 FROM supplier WHERE s_name ILIKE '%ering%')""")
def search_union_weighted(spark, sf_dir):
    """Five corpora with their own weights and null padding, ranked together."""
    q = parse_query("ering")

    def hits(name: str, key: str, tag: Column, weight: float) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.where(text_matches(F.col("text"), q)).select(F.lit(name).alias("corpus"), F.col(key).cast("bigint").alias("id"), tag.alias("tag"), text_score(F.col("text"), q, weight).alias("score"))

    none = F.lit(None).cast("string")
    parts = [hits("documents", "doc_id", F.col("lang"), 0.55), hits("benchmark", "item_id", none, 0.65), hits("conversations", "conv_id", F.col("role"), 1.0)]
    for name, table_, key, field, said, tag, score in (("parts", "part", "p_partkey", "p_name", "ring", F.col("p_brand"), 2.0), ("suppliers", "supplier", "s_suppkey", "s_name", "ering", none, 1.0)):
        parts.append(table(spark, sf_dir, table_).where(F.col(field).ilike(f"%{said}%")).select(F.lit(name).alias("corpus"), F.col(key).cast("bigint").alias("id"), tag.alias("tag"), F.lit(score).alias("score")))
    return reduce(DataFrame.unionByName, parts).select("corpus", "id", "tag", F.round("score", 6).alias("score"))
