"""The queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import chat, decontamination, hard_negatives, mixing, near_dups, quality_net, quality_rules, spot_sigs, substrings, suffixes, toxicity, url_filter, vector_codes
from noticeflow.llm.frames import documents

#: A conversation that holds the template's own control strings; added to the table's.
CONFLICT = ("user", "assistant"), r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = " UNION ALL ".join(f"SELECT -7L AS conv_id, {i}L AS turn, '{role}' AS role, r'{CONFLICT[1]}' AS text" for i, role in enumerate(CONFLICT[0]))
    return chat.digests(chat.format_conversations(rows.unionByName(spark.sql(extra))))


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judged(pages, URL_RULES, url_filter.default_trees()).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    net = quality_net.fit(docs, labels.where(~quality_net.held_out(F.col("doc_id"))))
    return quality_net.scored(docs, net).select("doc_id", quality_net.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.clustered(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) END)) AS x
  FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ways AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM both_ways JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r
), c AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substrings.deduplicated(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), k AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w)
), m AS (
  SELECT h, min(doc_id) AS least FROM k GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT k.doc_id, unnest(range(p, p + 50)) AS i FROM k JOIN m USING (h) WHERE least < k.doc_id)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '#', '#\'), '<', '<\'), ':', ':\') AS esc_text,
    replace(replace(replace(replace(role, '\', '\\'), '#', '#\'), '<', '<\'), ':', ':\') AS esc_role,
    contains(text, '</turn>') OR contains(text, '### ') OR contains(role, ': ') OR contains(role, '### ') OR contains(role, '</turn>') AS clash
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(role) + length(text) + 13) AS plain, sum(length(esc_role) + length(esc_text) + 13) AS escaped, bool_or(clash) AS was_escaped
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(CASE WHEN was_escaped THEN escaped + 3 ELSE plain END AS BIGINT) AS formatted_chars, was_escaped, true AS round_trip
FROM g
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixes.deduplicated(documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, p, md5(x[p:p + 399]) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 398)) AS p FROM d)
), again AS (
  SELECT h FROM w GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prior FROM w SEMI JOIN again USING (h)
), runs AS (
  SELECT doc_id, p, sum(CASE WHEN prior IS NULL OR p > prior + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit
), spans AS (
  SELECT doc_id, r, min(p) AS b, max(p) + 399 AS e FROM runs GROUP BY doc_id, r
), pieces AS (
  SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) + 1 AS f, b - 1 AS t, e - b + 1 AS cut FROM spans
  UNION ALL SELECT doc_id, max(e) + 1, NULL, 0 FROM spans GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(sum(cut), 0) AS BIGINT) AS n_removed, CAST(coalesce(count(t), 0) AS BIGINT) AS n_spans,
  sha256(coalesce(unhex(string_agg(CASE WHEN f IS NULL THEN hex(x) WHEN f > coalesce(t, n) THEN '' ELSE hex(x[f:coalesce(t, n)]) END, '' ORDER BY f)), ''::BLOB)) AS kept_sha256
FROM d LEFT JOIN pieces USING (doc_id) GROUP BY d.doc_id, n, x
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.in_order(mixing.mix(documents(spark, sf_dir)))
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", "positions")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality_rules.judged(documents(spark, sf_dir))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "whole_ratio", "n_chunks", "n_bad_chunks")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.judged(documents(spark, sf_dir), items)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.scored(docs, toxicity.fit(docs, labels))


def op11_spot_sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_sigs.compared(documents(spark, sf_dir))


_LIST = "[" + ", ".join(f"'{w}'" for w in spot_sigs.COMMON) + "]"
_SIGNED = f"""
  SELECT i, v, n, t, CASE WHEN len(s) > 0 THEN s ELSE e END AS s FROM (
    SELECT *,
      list_transform(list_filter(range(1, len(p) + 1), lambda j: p[j] - j < len(c)), lambda j: array_to_string([w[p[j]]] || c[p[j] - j + 1:p[j] - j + {spot_sigs.CHAIN}], ' ')) AS s,
      list_transform(range(1, 1 + greatest(len(w) - {spot_sigs.CHAIN - 1}, least(len(w), 1))), lambda j: array_to_string(w[j:j + {spot_sigs.CHAIN - 1}], ' ')) AS e
    FROM (SELECT *, list_filter(range(1, len(w) + 1), lambda j: list_contains({_LIST}, w[j])) AS p, list_filter(w, lambda x: NOT list_contains({_LIST}, x)) AS c
      FROM (SELECT *, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts)))
"""
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS i, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), pairs AS (
  SELECT a.i, a.doc_id, a.n, a.t, left(a.t, a.n - a.n // 4) || left(b.t, a.n // 4) AS e, b.i AS following
  FROM d a JOIN d b ON b.i = a.i % (SELECT count(*) FROM d) + 1
), texts AS (
  SELECT i, 0 AS v, n, t FROM d UNION ALL SELECT i, 1, n, e FROM pairs
), signed AS ({_SIGNED}
), f AS (
  SELECT i, v, list_sort(list_distinct(list_transform(s, lambda x: substr(md5(x), 1, {spot_sigs.CODE_HEX})))) AS f FROM signed
), met AS (
  SELECT pairs.doc_id, pairs.n, pairs.e, a.f AS a, b.f AS b, c.f AS c
  FROM pairs JOIN f a ON a.i = pairs.i AND a.v = 0 JOIN f b ON b.i = pairs.i AND b.v = 1 JOIN f c ON c.i = following AND c.v = 0
)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(len(a) = len(b) AS INT)::DOUBLE ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END AS near_edited,
  CASE WHEN len(a) = 0 OR len(c) = 0 THEN CAST(len(a) = len(c) AS INT)::DOUBLE ELSE len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c)))::DOUBLE END AS near_next,
  len(a) AS n_codes
FROM met
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds() -> str:
    """SQL of the rounds: codebooks b<r>, nearest entries a<r> (distance * 256 + index, whose least is the nearest of lowest index)."""
    near = "SELECT vec_id, p.k, min(list_sum(list_transform(list_zip(p.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + e) AS m FROM p JOIN b{r} b ON b.k = p.k GROUP BY vec_id, p.k"
    moved = """SELECT b.k, b.e, coalesce(m.q, b.q) AS q FROM b{r} b LEFT JOIN (
      SELECT k, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (
        SELECT k, e, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM (SELECT p.k, m % 256 AS e, q, unnest(range(1, len(q) + 1)) AS i FROM a{r} JOIN p USING (vec_id, k)) GROUP BY k, e, i
      ) GROUP BY k, e) m USING (k, e)"""
    out = []
    for r in range(vector_codes.ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (" + near.format(r=r) + ")")
        if r < vector_codes.ROUNDS:
            out.append(f"b{r + 1} AS MATERIALIZED (" + moved.format(r=r) + ")")
    return ", ".join(out)


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, k, q[k * (len(q) // {vector_codes.PARTS}) + 1:(k + 1) * (len(q) // {vector_codes.PARTS})] AS q FROM (SELECT vec_id, q, unnest(range({vector_codes.PARTS})) AS k FROM v)
), b0 AS MATERIALIZED (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, q FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {vector_codes.ENTRIES})
), {_rounds()}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY k) AS code, sum(m // 256)::BIGINT AS error FROM a{vector_codes.ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY k, e)) FROM b{vector_codes.ROUNDS}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


QUERIES = {
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
    "op11_spot_sigs": op11_spot_sigs,
    "op1_url_filter": op1_url_filter,
    "op2_quality_classifier": op2_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op10_toxicity": op10_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op3_near_dups": op3_near_dups,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format, "op7_mixing": op7_mixing, "op9_quality_rules": op9_quality_rules}
ORACLE_SQL = {"op6_suffix_dedup": OP6_SQL, "op3_near_dups": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_chat_format": OP5_SQL, "op11_spot_sigs": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_hard_negatives": OP13_SQL}
