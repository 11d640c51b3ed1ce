"""Queries of the training-text operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.llm.common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = predict(docs, train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from galvanite.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.context_tree import score_documents

    held_out = remainder(F.col("doc_id"), 7) == 2
    out = score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Each window's text is compared as it is; of equal ones all but the first are repeats.
OP3_SQL = f"""
WITH t AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS x FROM t WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM k WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM t),
left_ AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN left_ ON left_.doc_id = t.doc_id
"""

OP6_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM t),
f AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (n - k)),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b)
SELECT s.doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(least(r.c, s.doc_id)) AS component_id, s.doc_id = min(least(r.c, s.doc_id)) AS kept FROM s JOIN r ON r.v = s.doc_id GROUP BY s.doc_id
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from galvanite.llm.sentence_pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if the document that its path numbers is
    labelled as toxic or of low quality; a label that says neither is none."""
    from galvanite.llm.url_filter import host_of, judge_urls, path_of

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)', 1) as bigint)")
    named = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("host", number.alias("doc_id"))
    counted = named.where("doc_id is not null and host <> ''").groupBy("host", "doc_id").agg(F.count("*").alias("n"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    outcomes = counted.join(labels.where("toxic is not null or quality is not null").select("doc_id", bad.alias("bad")), "doc_id").groupBy("host").agg(F.sum(F.col("bad") * F.col("n")).alias("bad"), F.sum("n").alias("n"))
    return judge_urls(pages, outcomes, RULES)


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'), ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')) AS t(verdict, name, prefix, rule)),
hosts0 AS (SELECT p.host, CAST(sum(CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS n
  FROM p JOIN labels l ON l.doc_id = try_cast(regexp_extract(p.path, '([0-9]+)', 1) AS BIGINT) WHERE p.host <> '' AND (l.toxic IS NOT NULL OR l.quality IS NOT NULL) GROUP BY p.host),
hosts AS (SELECT *, labels[-1] AS suffix, array_to_string(list_concat([''], labels)[-2:], '.') AS domain FROM (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM hosts0)),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix),
g AS (SELECT 3 AS lv, bad, n FROM hosts UNION ALL SELECT 2, bad, n FROM domains UNION ALL SELECT 1, bad, n FROM suffixes),
s AS (SELECT lv, sum(bad) AS b, sum(n) AS t, count(*) AS c, sum(bad * bad / n) AS q, sum(n * n) AS nn, (sum(bad) + 1) / (sum(n) + 2) AS m FROM g GROUP BY lv),
k AS (SELECT lv, m, CASE WHEN t > nn / t AND (q - b * b / t - (c - 1) * m * (1 - m)) > 0
  THEN least(greatest(m * (1 - m) / ((q - b * b / t - (c - 1) * m * (1 - m)) / (t - nn / t)) - 1, 1.0), 1000.0) ELSE 1000.0 END AS k FROM s),
sr AS (SELECT suffix, (bad + k * m) / (n + k) AS rate FROM suffixes, k WHERE lv = 1),
dr AS (SELECT d.domain, d.suffix, (d.bad + k * sr.rate) / (d.n + k) AS rate FROM domains d JOIN sr USING (suffix), k WHERE lv = 2),
hr AS (SELECT h.host, h.n, k.k, (h.bad + k.k * dr.rate) / (h.n + k.k) AS rate FROM hosts h JOIN dr USING (domain, suffix), k WHERE lv = 3),
blocked AS (SELECT host FROM hr WHERE rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > 0.5),
best AS (SELECT p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict FROM (SELECT DISTINCT host, path FROM p) p
  JOIN r ON (p.host = r.name OR suffix(p.host, '.' || r.name)) AND starts_with(p.path, r.prefix) GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN p.host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(least(r.c, v.vec_id)) AS component_id, min(least(r.c, v.vec_id)) = v.vec_id AS kept
FROM v JOIN r ON r.v = v.vec_id GROUP BY v.vec_id
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.hard_negatives import hard_negatives

    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation begins with the first crc32(id) % 6 turns of the one
    whose id is its own, rounded to hundreds."""
    from galvanite.llm.conversation_trie import encoded, prefix_trie, with_heads
    from galvanite.llm.common import written

    own = written(encoded(table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie(written(with_heads(own, remainder(F.col("conv_id"), 6), 100, 5), "rebuilt"))


#: crc32 is computed bit by bit. Nodes are grouped by their whole prefix, subtrees by all prefixes of it.
OP12_SQL = """
WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, name) AS s, CAST(conv_id AS VARCHAR) AS digits FROM t GROUP BY conv_id),
heads AS (SELECT conv_id, s, xor(4294967295, list_reduce(range(8 * length(digits)), lambda c, i: xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(digits, i // 8 + 1, 1))) ELSE c END) >> 1,
  3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(digits, i // 8 + 1, 1))) ELSE c END) & 1)), 4294967295)) % 6 AS h FROM own),
rebuilt AS (SELECT o.conv_id, list_concat(CASE WHEN b.s IS NULL THEN [] ELSE b.s[1:o.h] END, o.s[o.h + 1:]) AS s FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
pre AS (SELECT conv_id, len(s) AS l, unnest(range(0, len(s) + 1)) AS d, s FROM rebuilt),
node AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (l = d), '') AS ends FROM pre GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT node.p, node.d, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d > 0 THEN (n - 1) * length(node.p[d].text) ELSE 0 END AS saved FROM node LEFT JOIN kids ON kids.p = node.p),
up AS (SELECT p, d, leaf, saved, unnest(range(0, d + 1)) AS a FROM own_sums),
sums AS (SELECT p[1:a] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved FROM up GROUP BY 1)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN sums ON sums.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node parent ON node.d > 0 AND parent.d = node.d - 1 AND parent.p = node.p[1:node.d - 1]
"""


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_context_tree, op3_substring_dedup, op4_language_id, op5_exact_dedup, op6_minhash_dedup, op7_sentencepiece, op8_url_filter, op9_embedding_dedup, op10_packing, op11_hard_negatives, op12_conversation_trie, op13_html_extraction)}
SQL: dict[str, str] = {"op3_substring_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op6_minhash_dedup": OP6_SQL, "op8_url_filter": OP8_SQL, "op9_embedding_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_conversation_trie": OP12_SQL}
