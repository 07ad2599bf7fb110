"""The numbered queries: thin wrappers that apply an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtracking, chat, warc
from .chunked_bpe import encode
from .collocations import collocations
from .common import read_table
from .ngram_join import jaccard_components
from .packing import pack
from .quality import quality
from .site_style import extract
from .syncmers import edited_fingerprints
from .term_matrix import filter_audit
from .toxicity import toxicity
from .unigram_counts import token_counts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_windows(turns.unionByName(more)))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtracking.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM p LEFT JOIN k USING (payload_digest)"""


_COLLOCATIONS_SQL = """WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
  words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
  grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spans, (VALUES (1), (2), (3), (4)) ks(k) WHERE i + k - 1 <= len(w)),
  f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  often AS (SELECT * FROM f WHERE f >= 30),
  cuts AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
  scores AS (SELECT c.lang, c.k, c.phrase, c.f AS a, c.cut, l.f AS l, r.f AS r, (2000000 * c.f) // (l.f + r.f) AS score FROM cuts c
    JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
  worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  longer AS (SELECT lang, k, f, string_split(phrase, ' ') AS w FROM often WHERE k > 2),
  starts AS (SELECT lang, k, f, w, unnest(range(1, k)) AS i FROM longer),
  inner_ AS (SELECT DISTINCT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM starts, (VALUES (2), (3)) ms(m) WHERE m < k AND i + m - 1 <= k),
  gone AS (SELECT DISTINCT o.lang, o.phrase FROM often o JOIN inner_ i ON i.lang = o.lang AND i.phrase = o.phrase WHERE 100 * i.f >= 80 * o.f),
  ranked AS (SELECT w.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst w ANTI JOIN gone g ON g.lang = w.lang AND g.phrase = w.phrase)
  SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

_AUDIT_SQL = """WITH rows_ AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  flags AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM rows_),
  known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  cells AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL),
  one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
  steps AS (SELECT filter_order, step::INT AS step, (1 << (strpos('ABCDE', filter_order[step]) - 1))::INT AS bit,
    list_sum(list_transform(string_split(filter_order[:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE (1 << (strpos('ABCDE', x) - 1))::INT END))::INT AS earlier FROM orders, range(1, 6) r(step)),
  out AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (failed & bit = 0 AND failed & coalesce(earlier, 0) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & coalesce(earlier, 0) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & coalesce(earlier, 0) <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & coalesce(earlier, 0) = 0 AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & coalesce(earlier, 0) = 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL)
  SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM out"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": _WARC_SQL, "op11_phrase_collocations": _COLLOCATIONS_SQL, "op12_filter_audit": _AUDIT_SQL}
