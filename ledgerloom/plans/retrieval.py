"""Search, citation graphs, vectors, chunks and pages over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunk import chunks
from ..functions.citations import citations
from ..functions.diff import line_diff, summary
from ..functions.markup import article_text, links
from ..operators import graph as G
from ..operators.search import STOP_WORDS, analyzed, bm25, composite_rank, headline, match_or_like, parse_query, postings, text_matches, weighted_score
from ..operators.vector import cosine, top_k
from ..sources.tables import small_batches, table
from .registry import query

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _found(spark, sf_dir, text: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(text_matches(F.col("text"), parse_query(text))).select("doc_id", "lang")


@query(f"SELECT doc_id, lang FROM documents WHERE list_contains({_WORDS}, 'ntly') AND list_contains({_WORDS}, 'ering')")
def docs_term_and(spark, sf_dir):
    return _found(spark, sf_dir, "ntly ering")


@query(f"SELECT doc_id, lang FROM documents WHERE list_contains({_WORDS}, 'ntly') OR list_contains({_WORDS}, 'heit')")
def docs_term_or(spark, sf_dir):
    return _found(spark, sf_dir, "ntly OR heit")


@query(f"SELECT doc_id, lang FROM documents WHERE list_contains({_WORDS}, 'ering') AND NOT list_contains({_WORDS}, 'ntly')")
def docs_term_not(spark, sf_dir):
    return _found(spark, sf_dir, "ering -ntly")


_PHRASE = "regexp_matches(lower(text), '(^|[^a-z0-9]){}[^a-z0-9]+{}([^a-z0-9]|$)')"


@query(f"SELECT doc_id, lang FROM documents WHERE {_PHRASE.format('er', 'er')} OR {_PHRASE.format('from', 'ering')} OR {_PHRASE.format('der', 'er')}")
def docs_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"er er" OR "from ering" OR "der er"')


@query(f"""SELECT doc_id, tf, round(score, 6) AS score FROM (WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'ntly')) AS a, len(list_filter(w, lambda x: x = 'ering')) AS b FROM d),
  s AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t)
  SELECT doc_id, a + b AS tf, ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)) AS score FROM t, s WHERE a > 0 AND b > 0)""")
def docs_tf_rank(spark, sf_dir):
    found = bm25(table(spark, sf_dir, "documents"), "doc_id", "text", parse_query("ntly ering"))
    return found.select("doc_id", F.col("tf").cast("bigint").alias("tf"), F.round("score", 6).alias("score"))


@query("""SELECT p_partkey, round(0.55 * hits + 1.5 * CASE WHEN p_brand ILIKE '%12%' THEN 1 ELSE 0 END + 2.0 * CASE WHEN p_name ILIKE '%part%' THEN 1 ELSE 0 END + 0.30 * log10(1 + coalesce(cited, 0)), 6) AS score FROM (
  SELECT p_partkey, p_brand, p_name, len(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: x = 'steel')) AS hits FROM part) LEFT JOIN (SELECT l_partkey, count(*) AS cited FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
  ORDER BY score DESC, p_partkey LIMIT 100""")
def search_boosted(spark, sf_dir):
    """Text score, field boosts and citation authority; the degree is aggregated before the join."""
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cited"))
    hits = F.size(F.filter(analyzed(F.col("p_type")), lambda w: w == "steel"))
    boosts = {"brand": (F.col("p_brand").ilike("%12%"), 1.5), "name": (F.col("p_name").ilike("%part%"), 2.0)}
    score = composite_rank(hits, 0.55, boosts, {"cited": (F.col("cited"), 0.30)})
    return table(spark, sf_dir, "part").join(cited, "p_partkey", "left").select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(100)


_COUNT = "len(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: x = '{}'))"


@query(f"""SELECT p_partkey, round(1.0 * ln(1 + {_COUNT.format("p_name", "part")}) + 0.4 * ln(1 + {_COUNT.format("p_type", "steel")}) + 1.0 * ln(1 + {_COUNT.format("p_name", "steel")}) + 0.4 * ln(1 + {_COUNT.format("p_type", "part")}), 6) AS score FROM part""")
def search_weighted_fields(spark, sf_dir):
    score = weighted_score({"p_name": 1.0, "p_type": 0.4}, parse_query("part OR steel"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("""SELECT p_partkey FROM part WHERE list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 'steel') OR p_brand ILIKE '%13%' OR p_name ILIKE '%13%'""")
def search_match_or_like(spark, sf_dir):
    return table(spark, sf_dir, "part").where(match_or_like(F.col("p_type"), parse_query("steel"), "13", F.col("p_brand"), F.col("p_name"))).select("p_partkey")


@query("""SELECT p_partkey, rank FROM (SELECT p_partkey, CASE WHEN p_name ILIKE '%part%1%' THEN 0 WHEN p_brand ILIKE '%1%' THEN 1 ELSE 2 END AS rank FROM part) WHERE rank < 2 ORDER BY rank, p_partkey LIMIT 1""")
def search_priority_lookup(spark, sf_dir):
    """A name match goes before a match of the other field; one row."""
    rank = F.when(F.col("p_name").ilike("%part%1%"), 0).when(F.col("p_brand").ilike("%1%"), 1).otherwise(2)
    return table(spark, sf_dir, "part").select("p_partkey", rank.alias("rank")).where("rank < 2").orderBy("rank", "p_partkey").limit(1)


@query(f"SELECT doc_id, n_chars FROM documents WHERE list_contains({_WORDS}, 'ntly') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def search_page(spark, sf_dir):
    hit = text_matches(F.col("text"), parse_query("ntly"))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(20)


def _corpora(spark, sf_dir):
    yield "documents", table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("tag"))
    yield "benchmark", table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(None).cast("string").alias("tag"))
    yield "conversations", table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.col("role").alias("tag"))


_HITS = f"""SELECT corpus, id, tag, hits FROM (SELECT 'documents' AS corpus, doc_id AS id, lang AS tag, len(list_filter({_WORDS}, lambda x: x = 'ering')) AS hits FROM documents
  UNION ALL SELECT 'benchmark', item_id, NULL, len(list_filter({_WORDS}, lambda x: x = 'ering')) FROM benchmark UNION ALL SELECT 'conversations', conv_id * 1000 + turn, role, len(list_filter({_WORDS}, lambda x: x = 'ering')) FROM conversations) WHERE hits > 0"""


def _hits(spark, sf_dir) -> DataFrame:
    count = F.size(F.filter(analyzed(F.col("text")), lambda w: w == "ering")).cast("bigint")
    parts = [df.select(F.lit(name).alias("corpus"), "id", "tag", count.alias("hits")) for name, df in _corpora(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts).where("hits > 0")


@query(f"SELECT * FROM ({_HITS}) ORDER BY hits DESC, corpus, id LIMIT 100")
def search_union_all(spark, sf_dir):
    return _hits(spark, sf_dir).orderBy(F.desc("hits"), "corpus", "id").limit(100)


@query(f"SELECT count(*) AS total, count(DISTINCT corpus) AS corpora FROM ({_HITS})")
def search_union_count(spark, sf_dir):
    return _hits(spark, sf_dir).agg(F.count("*").alias("total"), F.count_distinct("corpus").alias("corpora"))


@query(f"""SELECT corpus, id FROM ({_HITS}) QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY hits DESC, id) = 1""")
def search_best_per_corpus(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("hits"), "id"))
    return _hits(spark, sf_dir).withColumn("nth", nth).where("nth = 1").select("corpus", "id")


@query(f"SELECT lang, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, unnest({_WORDS}) AS term FROM documents) WHERE term IN ('the', 'ering', 'der', 'que') GROUP BY 1, 2")
def posting_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = postings(docs, "doc_id", {"text": 1.0}, ["the", "ering", "der", "que"]).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    return rows.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


_NO_KEYWORD = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@query(f"""WITH t AS (SELECT conv_id, turn, text, lead(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn, text) AS answer FROM conversations),
  k AS (SELECT conv_id, turn, answer, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9.+#-]{{2,}}'))) AS word FROM t WHERE answer IS NOT NULL)
  SELECT conv_id, turn, count(*) AS keywords, count(*) FILTER (WHERE contains(answer, lower(word))) AS covered FROM k WHERE lower(word) NOT IN ({_NO_KEYWORD}) GROUP BY 1, 2""")
def keyword_coverage(spark, sf_dir):
    """Keywords of a turn, each casing for itself and without stop words, that the next turn holds."""
    after = F.lead(F.lower("text")).over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", after.alias("answer")).where("answer IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9.+#-]{2,}"), F.lit(0)))
    rows = turns.select("conv_id", "turn", "answer", F.explode(words).alias("word")).where(~F.lower("word").isin(*sorted(STOP_WORDS)))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("keywords"), F.count_if(F.contains("answer", F.lower("word"))).alias("covered"))


@query()
def search_headlines(spark, sf_dir):
    q = parse_query('ntly "on thing" OR ering')
    docs = table(spark, sf_dir, "documents")
    return docs.where(text_matches(F.col("text"), q)).select("doc_id", headline(F.col("text"), q).alias("snippet"))


# --- graph ---

_EDGES = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) e"


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def _seeds(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))


@query(f"SELECT src, dst FROM {_EDGES} WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND dst IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def graph_seed_edges(spark, sf_dir):
    return G.inside(_edges(spark, sf_dir), _seeds(spark, sf_dir)).select("src", "dst")


@query(f"""WITH d AS (SELECT dst AS id, count(DISTINCT src) AS degree FROM {_EDGES} WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND dst NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1)
  SELECT id, degree FROM d WHERE degree >= 2 OR (SELECT count(*) FROM d WHERE degree >= 2) < 3 ORDER BY degree DESC, id LIMIT 30""")
def graph_neighbors_threshold(spark, sf_dir):
    return G.neighbours(_edges(spark, sf_dir), _seeds(spark, sf_dir))


@query(f"SELECT dst AS id, count(DISTINCT src) AS shared FROM {_EDGES} WHERE dst <> 7 AND src IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7) GROUP BY 1 ORDER BY shared DESC, id LIMIT 30")
def graph_hub(spark, sf_dir):
    return G.hub(_edges(spark, sf_dir), 7)


@query(f"SELECT id, coalesce(cites, 0) AS cites, coalesce(cited_by, 0) AS cited_by FROM (SELECT src AS id, count(*) AS cites FROM {_EDGES} GROUP BY 1) FULL JOIN (SELECT dst AS id, count(*) AS cited_by FROM {_EDGES} GROUP BY 1) USING (id)")
def graph_degrees(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@query(f"SELECT dst AS id FROM {_EDGES} WHERE src = 7 UNION SELECT src FROM {_EDGES} WHERE dst = 7 UNION SELECT 7")
def graph_ego(spark, sf_dir):
    return G.ego(_edges(spark, sf_dir), 7)


@query(f"SELECT src, dst FROM {_EDGES} QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 2")
def graph_top_per_source(spark, sf_dir):
    return G.top_per_source(_edges(spark, sf_dir), 2)


# --- vectors and chunks ---


def _query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_COSINE = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"


@query(f"SELECT e.vec_id, {_COSINE} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY similarity DESC, e.vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20)


@query(f"SELECT e.vec_id, {_COSINE} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label IN (1, 2) ORDER BY similarity DESC, e.vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings").where("label IN (1, 2)"), _query_vector(spark, sf_dir), 10)


@query("SELECT label, count(*) AS n, round(avg(list_sum(embedding::DOUBLE[])), 4) AS mean_sum FROM embeddings GROUP BY 1")
def vector_corpus_counts(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(total), 4).alias("mean_sum"))


@query("""SELECT conv_id, turn, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS ref, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1 AS new_source FROM (
  SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' ORDER BY length(text) DESC, conv_id, turn LIMIT 20)""")
def context_refs(spark, sf_dir):
    top = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("len")).orderBy(F.desc("len"), "conv_id", "turn").limit(20)
    ref = F.row_number().over(Window.orderBy(F.desc("len"), "conv_id", "turn"))  # twenty rows
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("len"), "turn")) == 1
    return top.select("conv_id", "turn", ref.cast("bigint").alias("ref"), first.alias("new_source"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS chunks FROM conversations GROUP BY 1")
def chunk_reassemble(spark, sf_dir):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("chunks"))


@query()
def chunk_paragraphs(spark, sf_dir):
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", F.explode(chunks(F.regexp_replace("text", "\n", "\n\n"), 200, 20)).alias("c"))
    return docs.select("doc_id", "c.*")


@query()
def citation_extract(spark, sf_dir):
    """Texts get a citation each, as the driver's documents have none."""
    said = F.concat_ws(" ", "text", F.format_string("See 25 l&N Dec. %d and Matter of Acme Corp., 2006-PER-%d.", F.col("doc_id") % 500, F.col("doc_id")))
    return citations(table(spark, sf_dir, "documents").select("doc_id", said.alias("text")), "doc_id", "text")


@query()
def html_links(spark, sf_dir):
    return links(table(spark, sf_dir, "pages"))


@query()
def html_text(spark, sf_dir):
    return article_text(small_batches(table(spark, sf_dir, "pages")))


@query()
def text_diff(spark, sf_dir):
    """Each benchmark item against itself with some words changed: a row for each pair of lines."""
    return line_diff(_compared(spark, sf_dir), "item_id")


def _compared(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "\\. ", ".\n").alias("reference"))
    return b.withColumn("compared", F.regexp_replace("reference", "\\bthe\\b", "a"))


@query(f"""SELECT item_id, changed = 0 AS "exact", CASE WHEN changed = 0 THEN 'Exact Match' ELSE 'Differences Found' END AS status,
  CASE WHEN changed = 0 THEN 'Texts are identical.' WHEN changed = 1 THEN '1 differing line.' ELSE changed || ' differing lines.' END AS detail, changed AS changed_lines FROM (
  SELECT item_id, coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> b[i] THEN 1 ELSE 0 END)), 0)::BIGINT AS changed FROM (
  SELECT item_id, string_split(r, chr(10)) AS a, string_split(regexp_replace(r, '\\bthe\\b', 'a', 'g'), chr(10)) AS b FROM (SELECT item_id, replace(text, '. ', '.' || chr(10)) AS r FROM benchmark)))""")
def text_diff_summary(spark, sf_dir):
    return summary(_compared(spark, sf_dir), "item_id")


@query(f"SELECT e.label, max({_COSINE}) AS best FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 GROUP BY 1")
def vector_best_per_label(spark, sf_dir):
    wanted = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    return table(spark, sf_dir, "embeddings").where("vec_id <> 0").groupBy("label").agg(F.max(F.round(cosine(F.col("embedding"), wanted), 6)).alias("best"))
