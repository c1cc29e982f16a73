"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.audit import audit_filters, mask_cells
from kgspark.llm.common import is_held_out
from kgspark.llm.decontaminate import contaminated_spans, hit_words
from kgspark.llm.exact_dedup import exact_dedup
from kgspark.llm.lines import remove_shared_lines
from kgspark.llm.minhash import near_duplicates
from kgspark.llm.mixing import mix_sources
from kgspark.llm.packing import pack_documents
from kgspark.llm.quality import fit_quality, score_quality
from kgspark.llm.spans import remove_repeated_spans
from kgspark.llm.suffixes import remove_repeated_bytes
from kgspark.llm.topk import top_k
from kgspark.llm.toxicity import fit_toxicity, score_toxicity
from kgspark.llm.trie import conversation_trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH hashed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM hashed
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""


def tokenizer_path() -> str:
    """The byte-level vocabulary of 50,257 ids among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more sources share; a null text counts as one empty line."""
    kept = remove_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.greatest("n_lines", F.lit(1)).alias("n_lines"), "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH numbered AS (
  SELECT *, row_number() OVER () AS row_key FROM documents
), lines AS (
  SELECT row_key, doc_id, source, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT row_key, doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM numbered)
), shared AS (
  SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.*, s.bare IS NOT NULL AS gone FROM lines l LEFT JOIN shared s ON l.bare = s.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_key, doc_id
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of sentences."""
    kept = remove_repeated_spans(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_sentences", "n_removed", "text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes, sources weighing 5, 2, 1 in turn."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources
), rated AS (
  SELECT *, row_number() OVER r AS place,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
           / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rate
  FROM weighed WINDOW r AS (ORDER BY 3 * source_size / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size,
         CASE WHEN rate >= 3 * source_size / weight THEN (3 * source_size)::DOUBLE
              ELSE (min(CASE WHEN rate < 3 * source_size / weight THEN {'place': place, 'rate': rate} END) OVER ()).rate * weight END AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shift
  FROM rated
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(k * each + shift) - floor((k - 1) * each + shift), ceil(each)))::BIGINT * size AS taken
FROM ranked
"""

def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of each hundredth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep without 400-byte strings that start more than once."""
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that windows of ten benchmark words cover."""
    hits = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_key, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM benchmark
), grams AS (
  SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[k:k + least(10, len(words)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM items WHERE len(words) > 0)
), runs AS (
  SELECT row_key, n, k, array_to_string(words[k:k + n - 1], ' ') AS gram
  FROM (SELECT row_key, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(words) >= n)
), hits AS (
  SELECT r.row_key, r.n, r.k, g.item FROM runs r JOIN grams g ON r.n = g.n AND r.gram = g.gram
), covered AS (
  SELECT row_key, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT row_key, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY row_key
), named AS (
  SELECT row_key, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row_key, item FROM hits) GROUP BY row_key
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (row_key) LEFT JOIN named USING (row_key)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS host,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.host AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), placed AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS code_points, sha256(length(role) || ':' || role || text) AS turn,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)
), visits AS (
  SELECT conv_id, depth, code_points, sha256(path) AS key, coalesce(lag(sha256(path)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM placed
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL FROM convs
), lengths AS (
  SELECT conv_id, max(depth) AS last FROM visits GROUP BY conv_id
), nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(code_points) AS code_points,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
  FROM visits JOIN lengths USING (conv_id) GROUP BY key
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT above.key, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum((below.n - 1) * below.code_points) AS saved_tokens
  FROM nodes below LEFT JOIN children c USING (key) JOIN visits above ON above.conv_id = below.conv_id AND above.depth <= below.depth GROUP BY above.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN children c ON c.key = n.key JOIN sums s ON s.key = n.key
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents of each language, in all 120 orders."""
    return audit_filters(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT w.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
         {'A': len(w) < 100,
          'B': 100 * len(list_distinct(w)) < 80 * len(w),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)} AS f
  FROM words w LEFT JOIN known k ON k.doc_id = w.doc_id
), cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic,
         f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS k,
         concat(CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END) AS failed
  FROM failing GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)
), judged AS (
  SELECT c.*, s.filter_order, s.step, contains(c.failed, s.own) AS fails, regexp_matches(c.failed, CASE WHEN s.earlier = '' THEN '0' ELSE '[' || s.earlier || ']' END) AS gone
  FROM cells c, steps s
)
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE fails AND k = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(n_good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost,
       coalesce(sum(n_toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // nullif(k, 0)) FILTER (WHERE fails), 0)::BIGINT AS shapley
FROM judged GROUP BY part, filter_order, step
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_top_k": op7_top_k,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op7_top_k": OP7_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
